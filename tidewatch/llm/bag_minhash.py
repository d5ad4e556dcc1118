"""Near-duplicate documents by BagMinHash over multisets of word shingles.

Signatures: a shingle that occurs w times owns Poisson processes over the weight layers (0, 1],
(1, 2], (2, 4], (4, 8] ... up to w; a point of a layer counts if its unit weight is at most w. Points
come in order of time and fall on random registers; a register keeps its earliest time, and a process
stops when its next point is later than every register. Equal registers of two texts estimate their
weighted Jaccard similarity without bias.

Texts with one multiset are one class from the start. Classes that agree on all registers of a band
meet in a bucket; a bucket links them by a maximum spanning forest over the estimates (and some
nearest neighbours where estimates are doubtful), never all pairs. Large buckets are dealt into chunks;
each chunk also gets the bucket's most central classes, so that what links to a common origin still
does. Links are verified by exact multiset overlap, and their components are the first groups.

What the links left apart is settled by prefixes: classes of a bucket of more than two that may be near
a class of another group (in a large bucket: all classes, if it holds more than one group) order their
shingles rarest first, and two of them at the threshold always share one among the first few
(`prefixes`). Such pairs of different groups are all verified unless their estimate rules them out
(less than 0.2 below the threshold counts as possible), so neither chunks nor the choice of links can
lose a pair that met in a bucket.

A class has a number of its own (`rep`), in the order of its smallest doc_id and its multiset; documents
come back in at the end only, so texts that share a doc_id, or have none, are told apart.

Defined cases: a text without words is a group of its own; one of fewer words than a shingle is one
shingle; a text of any length is one multiset; rows with one doc_id are rows of one document, which may
belong to several groups if their texts differ; a null doc_id sorts first, and a group that holds one is
named null; ties in estimates go to the class with the smaller number; an empty table gives no rows.
Other columns are not read by the operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.blocks import NO_ID
from tidewatch.llm.components import components
from tidewatch.llm.text import ALNUM, LOWER, bytes_of, materialised, mix, parts, pieces, prepare, word_hash, spans, window_hash

BANDS, BAND_ROWS = 24, 4
REGISTERS = BANDS * BAND_ROWS
CHUNK, CENTRAL = 800, 8
SLOTS = 1 << 20
_C = np.uint64(0x9E3779B97F4A7C15)
SIGNED = "doc long, tkey long, h1 long, h2 long, n long, bands array<long>, sig binary"


def shingles(data: np.ndarray, at: np.ndarray, size: int):
    """(row, hash, count) of each distinct shingle of each text, ordered by row."""
    low = LOWER[data]
    start, end, row = spans(ALNUM[low], at)
    word = word_hash(low, start, end)
    n = np.bincount(row, minlength=len(at) - 1)
    first = np.cumsum(n) - n
    h = window_hash(word, size)
    inside = row[:len(h)] == row[size - 1:size - 1 + len(h)]
    rows, keys = [row[:len(h)][inside]], [h[inside]]
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            rows.append(short)
            keys.append(window_hash(word, k)[first[short]])
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    edge = np.flatnonzero(new)
    return rows[edge], keys[edge], np.diff(np.append(edge, len(rows)))


def signatures(row: np.ndarray, key: np.ndarray, weight: np.ndarray, n_rows: int, registers: int = REGISTERS) -> np.ndarray:
    """Earliest times, one line a row; lines of rows without shingles stay infinite."""
    layers = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    at = np.repeat(np.arange(len(row)), layers)
    layer = np.arange(len(at)) - np.repeat(np.cumsum(layers) - layers, layers)
    row, weight = row[at], weight[at]
    key = mix(key[at] + _C * layer.astype(np.uint64))
    below = np.where(layer > 0, 1 << np.maximum(layer - 1, 0), 0)
    rate = np.maximum(below, 1) * float(registers)
    time, out = np.zeros(len(row)), np.full((n_rows, registers), np.inf)
    flat, step = out.reshape(-1), np.ones(1, np.uint64)
    while len(row):
        drawn = mix(key + _C * step)
        time = time - np.log(((drawn >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / rate
        drawn = mix(key + _C * (step + np.uint64(1)))
        register = ((drawn >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        unit = below + (drawn & np.uint64(0xFFFFFFFF)).astype(np.int64) % np.maximum(below, 1) + 1
        counts = unit <= weight
        np.minimum.at(flat, (row * registers + register)[counts], time[counts])
        go = time < out.max(axis=1)[row]
        row, key, weight, below, rate, time = row[go], key[go], weight[go], below[go], rate[go], time[go]
        step += np.uint64(2)
    return out


def _sign(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, at = bytes_of(b.column(1))
        doc, tkey = b.column(0).to_numpy(), b.column(2).to_numpy()
        for lo, hi, data_, at_ in pieces(data, at):
            row, key, weight = shingles(data_, at_, size)
            n = np.bincount(row, weights=weight, minlength=hi - lo).astype(np.int64)
            times = signatures(row, key, weight, hi - lo)
            bits = mix(times.view(np.uint64))
            band = np.zeros((hi - lo, BANDS), np.uint64)
            for j in range(BAND_ROWS):
                band = mix(band * _C + bits[:, j::BAND_ROWS])
            edge = np.flatnonzero(np.diff(np.append(-1, row)))
            ident = []
            for c in (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)):
                total = np.zeros(hi - lo, np.uint64)
                if len(row):
                    total[row[edge]] = np.add.reduceat(mix((key + weight.astype(np.uint64) * _C) * c), edge)
                ident.append(total.view(np.int64))
            short = (bits >> np.uint64(48)).astype(np.uint16)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BANDS), pa.array(band.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(doc[lo:hi]), pa.array(tkey[lo:hi]), *(pa.array(x) for x in (*ident, n)), lists,
                                              pa.array([x.tobytes() for x in short], pa.binary())], ["doc", "tkey", "h1", "h2", "n", "bands", "sig"])


def _forest(rep: np.ndarray, sig: np.ndarray, least: float) -> set:
    """Links of a maximum spanning forest over the estimates, and nearest neighbours where they are doubtful."""
    order = np.argsort(rep, kind="stable")  # so ties go to the smaller number
    rep, sig = rep[order], sig[order]
    n, k = sig.shape
    sure = least + 0.12
    best, parent, out = np.full(n, -1), np.zeros(n, np.int64), set()
    free = np.ones(n, bool)
    at = 0
    for _ in range(n):
        free[at] = False
        same = (sig == sig[at]).sum(axis=1)
        same[at] = -1
        if best[at] >= 0:
            if best[at] >= (least - 0.2) * k:
                out.add((int(rep[parent[at]]), int(rep[at])))
            if best[at] < sure * k:
                for j in np.argsort(-same, kind="stable")[:3]:
                    if same[j] >= (least - 0.2) * k:
                        out.add((int(rep[at]), int(rep[j])))
        closer = free & (same > best)
        best[closer], parent[closer] = same[closer], at
        if not free.any():
            break
        at = int(np.argmax(np.where(free, best, -2)))
    return {(min(p), max(p)) for p in out if p[0] != p[1]}


def _link(table: pa.Table, least: float) -> pa.Table:
    rep = table.column("rep").to_numpy()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(rep), -1)
    rep, at = np.unique(rep, return_index=True)
    got = sorted(_forest(rep, sig[at], least))
    return pa.table({"a": pa.array([p[0] for p in got], pa.int64()), "b": pa.array([p[1] for p in got], pa.int64())})


def _central(table: pa.Table) -> pa.Table:
    """The classes of a chunk that agree with most of the chunk, register by register."""
    rep = table.column("rep").to_numpy()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(rep), -1)
    score = np.zeros(len(rep), np.int64)
    for j in range(sig.shape[1]):
        value, where, count = np.unique(sig[:, j], return_inverse=True, return_counts=True)
        score += count[where]
    top = np.lexsort((rep, -score))[:CENTRAL]
    table = table.take(pa.array(top)).select(["band", "key", "rep", "sig"])
    return table.append_column("score", pa.array(score[top]))


def candidates(classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(a, b) pairs of classes to verify first, and the buckets of more than two; `classes` has rep, bands, sig."""
    banded = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    size = banded.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("rep").alias("a"), F.max("rep").alias("b")).filter("n > 1")
    size = materialised(size, "buckets")
    pairs = size.filter("n = 2").select("a", "b")
    crowd = banded.join(size.filter("n > 2").select("band", "key", "n"), ["band", "key"])
    crowd = crowd.withColumn("salt", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / CHUNK))).join(classes.select("rep", "sig"), "rep")
    crowd = materialised(crowd.select("band", "key", "salt", "n", "rep", "sig"), "crowds")
    large = crowd.filter(F.col("n") > CHUNK)
    central = (large.groupBy("band", "key", "salt").applyInArrow(_central, "band int, key long, rep long, sig binary, score long")
               .groupBy("band", "key").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "rep", "sig")), False), 1, CENTRAL).alias("top")))
    shared = (size.filter(F.col("n") > CHUNK).select("band", "key", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / CHUNK) - 1).cast("int"))).alias("salt"))
              .join(central, ["band", "key"]).select("band", "key", F.col("salt").cast("long").alias("salt"), F.explode("top").alias("t"))
              .select("band", "key", "salt", "t.rep", "t.sig"))
    chunks = crowd.select("band", "key", "salt", "rep", "sig").unionByName(shared)
    linked = chunks.groupBy("band", "key", "salt").applyInArrow(lambda t: _link(t, least), "a long, b long")
    return pairs.unionByName(linked).distinct(), crowd


def _doubtful(table: pa.Table, least: float) -> pa.Table:
    """The classes of a bucket that may be near one of another group."""
    root = table.column("root").to_numpy()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(root), -1)
    found = np.zeros(len(root), bool)
    for i in range(len(root)):
        found[i] = ((sig == sig[i]).sum(axis=1)[root != root[i]] >= (least - 0.2) * sig.shape[1]).any()
    return table.select(["rep", "root"]).filter(pa.array(found))


def unsettled(crowd: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """(rep, root) of the classes whose bucket holds classes of other groups that may be partners."""
    held = crowd.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = held.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("band", "key")
    held = materialised(held.join(mixed, ["band", "key"], "left_semi").select("band", "key", "n", "rep", "root", "sig"), "mixed")
    small = held.filter(F.col("n") <= CHUNK).select("band", "key", "rep", "root", "sig")
    small = small.groupBy("band", "key").applyInArrow(lambda t: _doubtful(t, least), "rep long, root long")
    return held.filter(F.col("n") > CHUNK).select("rep", "root").unionByName(small).distinct()


def _elements(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each shingle of each text, its copies numbered: overlap of multisets is overlap of these."""
    row, key, weight = shingles(data, at, size)
    which = np.repeat(np.arange(len(row)), weight)
    copy = np.arange(len(which)) - np.repeat(np.cumsum(weight) - weight, weight)
    return row[which], mix(key[which] + _C * copy.astype(np.uint64))


def _slots(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    count = np.zeros(SLOTS, np.int64)
    low, high = np.full(SLOTS, np.iinfo(np.int64).max), np.full(SLOTS, np.iinfo(np.int64).min)
    for b in batches:
        root = b.column(1).to_numpy()
        for lo, hi, data, at in pieces(*bytes_of(b.column(2))):
            row, element = _elements(data, at, size)
            slot, of = (element % np.uint64(SLOTS)).astype(np.int64), root[lo:hi][row]
            count += np.bincount(slot, minlength=SLOTS)
            np.minimum.at(low, slot, of)
            np.maximum.at(high, slot, of)
    found = np.flatnonzero(count)
    for lo in range(0, len(found), 50_000):
        part = found[lo:lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(x[part]) for x in (count, low, high))], ["slot", "n", "low", "high"])


def _prefixes(batches: Iterator[pa.RecordBatch], size: int, least: float, table) -> Iterator[pa.RecordBatch]:
    count, mixed = table.value
    for b in batches:
        rep, root = b.column(0).to_numpy(), b.column(1).to_numpy()
        for lo, hi, data, at in pieces(*bytes_of(b.column(2))):
            row, element = _elements(data, at, size)
            slot = (element % np.uint64(SLOTS)).astype(np.int64)
            order = np.lexsort((element, count[slot], row))
            row, element, slot = row[order], element[order], slot[order]
            n = np.bincount(row, minlength=hi - lo)
            place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
            long, short = (n - np.ceil(n * x - 1e-9).astype(np.int64) for x in (least, 2 * least / (1 + least)))
            keep = (place <= long[row]) & mixed[slot]
            row, element, place = row[keep], element[keep], place[keep]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (element.view(np.int64), rep[lo:hi][row], root[lo:hi][row], n[row].astype(np.int64), place, place <= short[row])],
                                             ["element", "rep", "root", "n", "place", "short"])


def prefixes(texts: DataFrame, least: float, size: int) -> DataFrame:
    """(element, rep, root, n, place, short): the rarest elements of each text; `texts` has rep, root, text.

    Two texts of n <= m elements with similarity `least` or more have 2 least / (1 + least) n and least m
    or more of them in common. So in any common order the first shared one is among the first
    n - ceil(2 least / (1 + least) n) + 1 of the smaller text (`short`) and the first m - ceil(least m) + 1
    of the other. Rarity is counted in SLOTS counters, which only decide the order; an element whose
    counter saw one group alone can't join two and isn't given.
    """
    seen = texts.mapInArrow(lambda it: _slots(it, size), "slot int, n long, low long, high long")
    seen = seen.groupBy("slot").agg(F.sum("n").alias("n"), (F.min("low") < F.max("high")).alias("mixed")).toArrow()
    count, mixed, slot = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, bool), seen.column("slot").to_numpy()
    count[slot], mixed[slot] = seen.column("n").to_numpy(), seen.column("mixed").to_numpy()
    table = texts.sparkSession.sparkContext.broadcast((count, mixed))
    return texts.mapInArrow(lambda it: _prefixes(it, size, least, table), "element long, rep long, root long, n long, place long, short boolean")


def _possible(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        one, two = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(len(b), -1) for i in (2, 3))
        yield b.select([0, 1]).filter(pa.array((one == two).sum(axis=1) >= (least - 0.2) * REGISTERS))


def meetings(found: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(a, b) of all pairs of different groups that share a prefix element and may reach `least`."""
    small = found.filter("short").select("element", F.col("rep").alias("p"), F.col("root").alias("p_root"), F.col("n").alias("p_n"), F.col("place").alias("p_at"))
    other = found.select("element", F.col("rep").alias("q"), F.col("root").alias("q_root"), F.col("n").alias("q_n"), F.col("place").alias("q_at"))
    fits = (F.col("p_root") != F.col("q_root")) & ((F.col("p_n") < F.col("q_n")) | (F.col("p_n") == F.col("q_n")) & (F.col("p") < F.col("q")))
    # behind their first shared element both must have enough left
    left = F.least(F.col("p_n") - F.col("p_at"), F.col("q_n") - F.col("q_at")) >= (F.col("p_n") + F.col("q_n")) * (least / (1 + least)) - 1e-6
    pairs = small.join(other, "element").filter(fits & left & (F.col("p_n") >= F.col("q_n") * least - 1e-6))
    pairs = pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("rep").alias(side), F.col("sig").alias(f"sig_{side}")), side)
    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(lambda it: _possible(it, least), "a long, b long")


def _overlap(batches: Iterator[pa.RecordBatch], size: int, least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = np.zeros(len(b), bool)
        sides = [bytes_of(b.column(i)) for i in (2, 3)]
        for i in range(len(b)):
            (_, ka, wa), (_, kb, wb) = (shingles(d[at[i]:at[i + 1]], np.array([0, at[i + 1] - at[i]]), size) for d, at in sides)
            where = np.minimum(np.searchsorted(kb, ka), max(len(kb) - 1, 0))
            both = np.minimum(wa, wb[where])[kb[where] == ka].sum() if len(kb) else 0
            keep[i] = both >= least * (wa.sum() + wb.sum() - both) and both > 0
        yield b.select([0, 1]).filter(pa.array(keep))


def _texts_of(reps: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """`reps` with one text of each class."""
    where = reps.join(classes.select("rep", "doc", "tkey"), "rep")
    return texts.join(where, ["doc", "tkey"]).groupBy(*reps.columns).agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, least: float, size: int) -> DataFrame:
    """Those (a, b) whose multisets overlap as much as asked."""
    wanted = materialised(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "wanted")
    chosen = materialised(_texts_of(wanted, classes, texts), "candidate-texts")
    sides = pairs.join(chosen.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    sides = sides.join(chosen.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return sides.mapInArrow(lambda it: _overlap(it, size, least), "a long, b long")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, text, tkey): the key tells apart texts under one doc_id."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")).alias("doc"), "text", F.xxhash64("text").alias("tkey"))


def _grouped(docs: DataFrame, least: float, size: int) -> DataFrame:
    """(doc, tkey, group, named, n_links) of every row; `named` tells the rows whose class and document give the group its name."""
    spark = prepare(docs.sparkSession)
    texts = _keyed(docs)
    signed = materialised(texts.mapInArrow(lambda it: _sign(it, size), SIGNED), "signatures")
    classes = (signed.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min(F.struct("doc", "tkey")).alias("at"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
               .select("at.doc", "at.tkey", "h1", "h2", "n", "bands", "sig"))
    classes = classes.repartitionByRange(parts(spark), "doc", "h1", "h2").sortWithinPartitions("doc", "h1", "h2", "n")
    classes = materialised(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    pairs, crowd = candidates(classes, least)
    pairs = materialised(pairs, "candidates")
    links = materialised(verified(pairs, classes, texts, least, size), "links")
    roots = components(links)
    apart = materialised(unsettled(crowd, roots, least), "unsettled")
    if not apart.isEmpty():
        read = _texts_of(apart, classes, texts)
        found = materialised(prefixes(materialised(read, "unsettled-texts"), least, size), "prefixes")
        late = materialised(meetings(found, classes, least).join(pairs, ["a", "b"], "left_anti"), "meetings")
        late = materialised(verified(late, classes, texts, least, size), "late-links")
        if not late.isEmpty():
            links = links.unionByName(late)
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late))
    count = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    found = (classes.select("h1", "h2", "n", "rep", "doc").join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(count, "rep", "left")
             .select("h1", "h2", "n", "rep", "doc", F.coalesce("root", "rep").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    name = found.filter("rep = root").select("root", F.col("doc").alias("group"))  # the least number has the least document
    found = found.join(name, "root").select("h1", "h2", "n", "group", (F.col("rep") == F.col("root")).alias("first"), "n_links")
    member = signed.filter("n > 0").select("doc", "tkey", "h1", "h2", "n").join(found, ["h1", "h2", "n"])
    member = member.select("doc", "tkey", "group", (F.col("first") & (F.col("doc") == F.col("group"))).alias("named"), "n_links")
    bare = signed.filter("n = 0").select("doc", "tkey", F.col("doc").alias("group"), F.lit(True).alias("named"), F.lit(0).cast("long").alias("n_links"))
    return member.unionByName(bare)


def groups(docs: DataFrame, least: float = 0.8, size: int = 5) -> DataFrame:
    """(doc_id, group_id, n_links): the smallest doc_id of the group, and how many links of the document's class were verified.

    n_links counts the links that joined the groups, not all near texts: pairs that links have already joined are
    not tried.
    """
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return _grouped(docs, least, size).select(real("doc").alias("doc_id"), real("group").alias("group_id"), "n_links")


def keep_one(docs: DataFrame, least: float = 0.8, size: int = 5) -> DataFrame:
    """The document that names each group, all columns kept; texts without words all stay.

    Its rows stay if they have the words of its first class, so of several near texts under one doc_id, or
    without any, one class stays.
    """
    stay = _grouped(docs, least, size).filter("named").select(F.col("doc").alias("_doc"), F.col("tkey").alias("_tkey")).distinct()
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long"))
    return docs.join(stay, (doc == F.col("_doc")) & (F.xxhash64("text") == F.col("_tkey")), "left_semi")
