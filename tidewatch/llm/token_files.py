"""Token ids of a corpus in grammar-compressed shards (Re-Pair), with random access.

Documents are dealt into tasks by range of doc_id and sorted; a task cuts its stream of ids into
shards at document ends. In a shard, frequent pairs of neighbouring symbols are replaced by new symbols,
round after round: a round takes the pairs within a factor of the most frequent one, the more frequent
pair first where they overlap; the factor falls until pairs that occur `LEAST` times are in, and rounds end
when one of these saves less than `LITTLE` of the symbols. No symbol crosses a document's end. A shard is one row of a Parquet table:

    part, shard        place of the task and of the shard in the task; their order is the order of doc_id
    first_token        ids of the task that stand before the shard
    doc_id             ids of the shard's documents
    n_tokens           how many ids each has, with the end id
    n_symbols          how many symbols each has
    base               rule k is the symbol base + k; smaller symbols are ids
    rules              left and right symbol of each rule, 32 bits each, least byte first
    lengths            into how many ids each rule expands, 32 bits each
    symbols            the shard's symbols, 32 bits each

All sums over documents before a task come from one small table of a row for each task, so the files are
written in one pass and never rewritten. A task's write is Spark's, so a repeated task replaces itself.

Defined cases: null or empty text has the end id only; a null doc_id comes first; rows with one doc_id
follow each other in the order of a hash of their texts; a text longer than a shard is a shard of its own; an empty
table gives no shards. Special strings inside texts are read as the tokenizer's default says.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.text import parts, prepare, scratch

SHARD_TOKENS, MERGED_BYTES = 1 << 20, 1 << 23
KEPT, LONGEST_KEPT = 250_000, 64
# Latin text without characters that are hard to class, and without special strings
_ODD = re.compile("[^\n\t\r -~\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u012f\u0131-\u017f]|<\\|")
_ONE = np.frombuffer(b"stmd", np.uint8)
_KIND = np.ones(256, np.uint8)
_KIND[[9, 10, 13, 32]], _KIND[48:58], _KIND[97:123], _KIND[128:] = 0, 2, 3, 3
LEAST, FACTOR, LITTLE, SLOT_BITS = 16, 4, 0.01, 18
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
SHARD = ("part long, shard long, first_token long, doc_id array<long>, n_tokens array<long>, n_symbols array<long>, base long, "
         "rules binary, lengths binary, symbols binary")
NAMES = [x.split()[0] for x in SHARD.split(", ")]


class Encoder:
    """Ids of texts as the tokenizers library gives them.

    The library spends most of its time on normalising and cutting. Texts of Latin letters alone are cut
    here (`_cut`), and each distinct word goes to the library's model once. Other texts go to the library
    run by run between blanks, which the tokenizer drops and never joins over. Words and runs are
    remembered in two generations: what was not used for a while is forgotten.
    """

    def __init__(self, stated: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.known = Tokenizer.from_str(stated)
        self.model, self.fast = self.known.model, cuts_latin_words(json.loads(stated))
        self.words, self.runs = ({}, {}), ({}, {})

    def _word(self, x: bytes) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(x.decode() if x.isascii() else "".join(map(_BYTE.__getitem__, x)))]).tobytes()

    def _run(self, x: str) -> bytes:
        return array("I", self.known.encode(x, add_special_tokens=False).ids).tobytes()

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        held, size = [], 0
        for i, x in enumerate(texts):
            if not self.fast or _ODD.search(x):
                runs = x.replace("\n", " ").split(" ")
                found = self._kept("runs", set(runs), self._run)
                out[i] = np.frombuffer(b"".join(map(found.__getitem__, runs)), np.uint32)
            else:
                held.append(i)
                size += len(x)
                if size > MERGED_BYTES:
                    self._latin(texts, held, out)
                    held, size = [], 0
        self._latin(texts, held, out)
        return out

    def _latin(self, texts: list[str], held: list[int], out: list[np.ndarray]) -> None:
        data = [texts[i].lower().encode() for i in held]
        at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in data])]).astype(np.int64)
        start, stay, low = _cut(np.frombuffer(b" ".join(data) + b" ", np.uint8))
        if not len(start):
            return
        before = np.cumsum(stay, dtype=np.int32)
        ends = np.append(before[start] - 1, before[-1]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(low[stay])]).dictionary_encode()
        code, each = words.indices.to_numpy().astype(np.int64), words.dictionary
        cuts, whole = np.frombuffer(each.buffers()[1], np.int64)[each.offset:each.offset + len(each) + 1].tolist(), each.buffers()[2].to_pybytes()
        each = [whole[i:j] for i, j in zip(cuts, cuts[1:])]
        found = self._kept("words", set(each), self._word)
        packed = list(map(found.__getitem__, each))
        flat, size = np.frombuffer(b"".join(packed), np.uint32), np.array([len(x) >> 2 for x in packed])
        first = (np.cumsum(size) - size)[code]
        size = size[code]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])]
        cuts = upto[np.searchsorted(start, at)]
        for j, i in enumerate(held):
            out[i] = ids[cuts[j]:cuts[j + 1]]

    def _kept(self, name: str, wanted: set, make) -> dict:
        young, old = getattr(self, name)
        if len(young) > KEPT:
            young, old = {}, {x: got for x, got in young.items() if len(x) <= LONGEST_KEPT}
            setattr(self, name, (young, old))
        for x in wanted - young.keys():
            got = old.get(x)
            young[x] = make(x) if got is None else got
        return young


def _cut(low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each word starts, which bytes belong to words, the bytes) of lower-case Latin text.

    Words are runs of letters, single digits, runs of signs; an apostrophe alone before s, t, re, ve, m, ll, d
    is one word with it.
    """
    kind = _KIND[low]  # 0 blank, 1 sign, 2 digit, 3 letter
    two = np.flatnonzero(low >= 0xC2)  # lead bytes of two-byte characters
    lead, trail = low[two], low[two + 1]
    sign = (lead == 0xC2) & (trail != 0xAA) & (trail != 0xB5) & (trail != 0xBA) | (lead == 0xC3) & ((trail == 0x97) | (trail == 0xB7))
    kind[two] = kind[two + 1] = np.where(sign, 1, 3)
    stay = kind > 0
    new = stay.copy()
    new[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    quote = np.flatnonzero(low == 39)
    quote = quote[new[quote] & (kind[np.minimum(quote + 1, len(low) - 1)] == 3)]  # an apostrophe alone, then a letter
    if len(quote):
        a, b = low[quote + 1], low[np.minimum(quote + 2, len(low) - 1)]
        one = np.isin(a, _ONE)
        both = ~one & ((a == 114) & (b == 101) | (a == 118) & (b == 101) | (a == 108) & (b == 108))
        for taken, n in ((quote[one], 1), (quote[both], 2)):
            new[taken + 1] = False
            after = taken + 1 + n
            more = after[after < len(low)]
            new[more[stay[more]]] = True  # what follows begins anew
    return np.flatnonzero(new), stay, low


def splits_at_blanks(stated: str) -> bool:
    """Whether the tokenizer forgets blanks between words, so that `Encoder` may cut texts there."""
    from tokenizers import Tokenizer

    known = Tokenizer.from_str(stated)
    ids = lambda x: known.encode(x, add_special_tokens=False).ids
    return all(ids(f"{a}{gap}{b}") == ids(a) + ids(b) for a in ("one", "1", ".") for b in ("two", "2", "'s") for gap in (" ", "\n", " \n "))


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return [chr(b) if b in own else chr(256 + sum(x not in own for x in range(b))) for b in range(256)]


_BYTE = _byte_letters()


def cuts_latin_words(stated: dict) -> bool:
    """Whether this is a tokenizer that `_cut` cuts for: lower case; words, single digits, runs of signs."""
    steps = [x.get("type") for x in (stated.get("normalizer") or {}).get("normalizers", [])]
    cuts = (stated.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return (steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["invert"]
            and cuts[0]["behavior"] == "Removed" and cuts[0]["pattern"].get("Regex") == pattern and not cuts[1]["add_prefix_space"])


def compress(ids: np.ndarray, ends: np.ndarray, base: int, least: int = LEAST, factor: int = FACTOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rules, lengths, symbols, symbols before each document's end) of ids whose documents end at `ends`."""
    symbol, last = ids.astype(np.uint32, copy=True), np.zeros(len(ids), bool)
    last[ends[ends > 0] - 1] = True
    rules, n, bar = [], 0, None
    while len(symbol) > 1:
        # counters of hashed pairs tell which places can belong to a frequent pair; only these are sorted
        slot = ((symbol[:-1] * _A ^ symbol[1:] * _B) * _A >> np.uint32(32 - SLOT_BITS)).astype(np.int64)
        slot[last[:-1]] = 1 << SLOT_BITS
        seen = np.bincount(slot, minlength=(1 << SLOT_BITS) + 1)
        seen[-1] = 0
        bar = max(least, int(seen.max()) // factor if bar is None else bar // factor)
        maybe = np.flatnonzero((seen >= bar)[slot])
        pair = symbol[maybe].astype(np.uint64) << np.uint64(32) | symbol[maybe + 1]
        key = np.sort(pair)
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(edge, len(key)))
        key, count = key[edge[count >= bar]], count[count >= bar]
        if not len(key):
            if bar == least:
                break
            continue
        rank = np.empty(len(key), np.int32)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(key))
        where = np.minimum(np.searchsorted(key, pair), len(key) - 1)
        hit = key[where] == pair
        order = np.full(len(symbol) + 1, len(key), np.int32)  # no pair to the left of the first and to the right of the last
        at = maybe[hit]
        order[1 + at] = here = rank[where[hit]]
        best = (here <= order[at]) & (here <= order[at + 2])
        at, here = at[best], here[best]
        run = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (here[1:] != here[:-1])))
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]  # of a run such as aaaa every other pair
        here = order[at + 1]
        used = np.bincount(here)
        worth = used >= min(least, int(used.max()))
        at = at[worth[here]]
        new = (np.cumsum(worth) - 1)[order[at + 1]]
        rule = np.zeros((int(worth.sum()), 2), np.uint32)
        rule[new, 0], rule[new, 1] = symbol[at], symbol[at + 1]
        rules.append(rule)
        symbol[at], last[at] = (new + (n + base)).astype(np.uint32), last[at + 1]
        n += len(rule)
        stay = np.ones(len(symbol), bool)
        stay[at + 1] = False
        symbol, last = symbol[stay], last[stay]
        if bar == least and len(at) < LITTLE * len(symbol):
            break
    length = np.zeros(n, np.uint32)
    done = 0
    for rule in rules:  # a rule's sides are ids or earlier rules
        sides = rule.astype(np.int64) - base
        length[done:done + len(rule)] = np.where(sides < 0, 1, length[np.maximum(sides, 0)]).sum(axis=1)
        done += len(rule)
    full = np.concatenate([[0], np.flatnonzero(last) + 1])
    filled = np.cumsum(np.diff(np.concatenate([[0], ends])) > 0)
    return np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), length, symbol, full[filled]


class Shard:
    """One shard, read without expanding more than is asked for."""

    def __init__(self, row: dict):
        self.base = row["base"]
        self.rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2).astype(np.int64)
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.symbols = np.frombuffer(row["symbols"], "<u4").astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(np.asarray(row["n_symbols"], np.int64))])
        self._spelt = None

    def _spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rules one after another, and where each rule's begin."""
        if self._spelt is None:
            at = np.concatenate([[0], np.cumsum(self.lengths)])
            out = np.zeros(at[-1], np.uint32)
            known = np.zeros(len(self.rules), bool)
            todo = np.arange(len(self.rules))
            while len(todo):  # rules whose two sides are known, level by level
                sides = self.rules[todo] - self.base
                ready = ((sides < 0) | known[np.maximum(sides, 0)]).all(axis=1)
                now = todo[ready]
                write = at[now]
                for side in (0, 1):
                    symbol = self.rules[now, side]
                    write = write + _spell(symbol, self.base, self.lengths, at, out, write, out)
                known[now] = True
                todo = todo[~ready]
            self._spelt = out, at
        return self._spelt

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        spelt, at = self._spelled()
        size = self.sizes(symbols)
        ids = np.zeros(size.sum(), np.uint32)
        _spell(symbols, self.base, self.lengths, at, spelt, np.cumsum(size) - size, ids)
        return ids

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols - self.base
        return np.where(rule < 0, 1, self.lengths[np.maximum(rule, 0)] if len(self.lengths) else 1)

    def all(self) -> np.ndarray:
        return self.expand(self.symbols)

    def document(self, j: int) -> np.ndarray:
        """Ids of the shard's j-th document."""
        return self.expand(self.symbols[self.starts[j]:self.starts[j + 1]])

    def span(self, j: int, start: int, end: int) -> np.ndarray:
        """Ids `start` to `end` of the j-th document; only the symbols that hold them are expanded."""
        symbols = self.symbols[self.starts[j]:self.starts[j + 1]]
        after = np.cumsum(self.sizes(symbols))
        lo, hi = np.searchsorted(after, start, "right"), np.searchsorted(after, end, "left") + 1
        skipped = int(after[lo - 1]) if lo else 0
        return self.expand(symbols[lo:hi])[start - skipped:max(start, end) - skipped]


def _spell(symbol, base, lengths, at, source, write, target) -> np.ndarray:
    """Write each symbol's ids from `source` to its place in `target`; gives how many each has."""
    rule = symbol - base
    plain = rule < 0
    target[write[plain]] = symbol[plain]
    size = np.ones(len(symbol), np.int64)
    long = np.flatnonzero(~plain)
    if len(long):
        n = size[long] = lengths[rule[long]]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        target[np.repeat(write[long], n) + step] = source[np.repeat(at[rule[long]], n) + step]
    return size


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together up to about MERGED_BYTES, since many texts share their words."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= MERGED_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _shards(batches: Iterator[pa.RecordBatch], tokenizer, end_id: int, limit: int) -> Iterator[pa.RecordBatch]:
    found = Encoder(tokenizer.value)
    base = max(found.known.get_vocab_size(with_added_tokens=True), end_id + 1)
    part, shard, before = TaskContext.get().partitionId(), 0, 0
    doc, held, n_held = [], [], 0

    def row() -> pa.RecordBatch:
        n = np.array([len(x) for x in held], np.int64)
        rules, lengths, symbols, ends = compress(np.concatenate(held), np.cumsum(n), base)
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (doc, n.tolist(), np.diff(np.concatenate([[0], ends])).tolist())]
        binary = [pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (rules, lengths, symbols)]
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([shard]), pa.array([before]), *lists, pa.array([base]), *binary], NAMES)

    end = np.array([end_id], np.uint32)
    for b in _merged(batches):
        for i, ids in zip(b.column(0).to_pylist(), found.texts([x or "" for x in b.column(1).to_pylist()])):
            if held and n_held + len(ids) >= limit:
                yield row()
                shard, before, n_held = shard + 1, before + n_held, 0
                doc, held = [], []
            doc.append(i)
            held.append(np.concatenate([ids, end]))
            n_held += len(ids) + 1
    if held:
        yield row()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, limit: int = SHARD_TOKENS) -> None:
    """Encode every text, append `end_id` and write shards in ascending order of doc_id."""
    with open(tokenizer, encoding="utf-8") as f:
        stated = f.read()
    if not splits_at_blanks(stated):
        raise ValueError("this tokenizer keeps blanks; its words depend on them")
    spark = prepare(docs.sparkSession)
    known = spark.sparkContext.broadcast(stated)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts(spark), F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    shards = rows.select("doc_id", "text").mapInArrow(lambda it: _shards(it, known, end_id, limit), SHARD)
    shards.write.mode("overwrite").option("compression", "zstd").parquet(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(path)


def _documents(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    names = ["part", "doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"]
    for b in batches:
        for row in b.to_pylist():
            n = np.asarray(row["n_tokens"], np.int64)
            ids, ends = Shard(row).all(), np.cumsum(n)
            cuts = [(x - y, x) for x, y in zip(ends.tolist(), n.tolist())]
            if digest:
                raw = memoryview(ids.astype("<u4").tobytes())
                last = pa.array([zlib.crc32(raw[4 * a:4 * z]) for a, z in cuts], pa.int64())
            else:
                last = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), row["part"], np.int64)), pa.array(row["doc_id"], pa.int64()),
                                              pa.array(row["first_token"] + ends - n), pa.array(n), last], names)


def _placed(stored: DataFrame, found: DataFrame, last: str) -> DataFrame:
    """Add the ids of all tasks before to each start; one row for each task is summed up."""
    total = stored.select("part", F.expr("aggregate(n_tokens, 0L, (x, y) -> x + y)").alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = total.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return found.join(before, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", last)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files."""
    stored = shards(prepare(spark), path)
    return _placed(stored, stored.mapInArrow(lambda it: _documents(it, False), "part long, doc_id long, start long, n_tokens long, ids array<int>"), "ids")


def read_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents named; only their shards are read, only their symbols expanded."""
    wanted = set(ids)

    def found(batches):
        for b in batches:
            for row in b.to_pylist():
                shard, at = Shard(row), [j for j, i in enumerate(row["doc_id"]) if i in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"][j] for j in at], pa.int64()),
                                                  pa.array([shard.document(j).tolist() for j in at], pa.list_(pa.int32()))], ["doc_id", "ids"])

    held = F.arrays_overlap("doc_id", F.array(*[F.lit(i).cast("long") for i in wanted]))
    return shards(prepare(spark), path).filter(held).mapInArrow(found, "doc_id long, ids array<int>")


def digests(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files written for `docs`."""
    spark = docs.sparkSession
    path = scratch(spark, "token-files")
    write(docs, path, tokenizer, end_id)
    stored = shards(spark, path)
    found = stored.mapInArrow(lambda it: _documents(it, True), "part long, doc_id long, start long, n_tokens long, ids_crc32 long")
    return _placed(stored, found, "ids_crc32")
