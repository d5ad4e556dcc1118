"""Phrases whose words occur together more often than apart, found by Rabin-Karp fingerprints.

A text is lower-cased (A-Z), cut into pieces at `. , ; : ! ?` and line ends, and pieces into words.
Prefix polynomials over the word hashes of a batch give the fingerprint of every n-gram of its pieces;
language and length are mixed in. A batch sorts its fingerprints and sends each one with its count; the
shuffle adds the counts up.

1. Words and pairs are counted. A fingerprint seen `least` times or more stays.
2. N-grams of three or four words are counted if every pair inside them stayed.
3. The texts are read again: occurrences behind a fingerprint that stayed are grouped by their exact
   words inside the batch, the phrase is materialised from the group's first place, and counts and
   pointers (document, byte) are gathered by language and phrase. Two phrases with one fingerprint part
   here, so counts are exact; only phrases behind such a fingerprint ever become strings.

What stayed is told to the tasks by a bit table of bounded size (`_told`); a chance hit in it only
costs a row more. Scores, containment and ranks are joins, aggregates and a window over the phrases
that stayed.

Defined cases: null or empty text has no words; a null lang is `und`; words are not normalised beyond
A-Z and may be of any length; repeated rows all count; ties in score go to the more frequent, then to the
smaller phrase; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.blocks import NO_ID
from tidewatch.llm.text import LOWER, byte_class, bytes_of, materialised, mix, pieces, prepare, word_hash, spans, window_hash

MOST_WORDS = 4
CUT = byte_class([(0x0A, 0x0D)] + [(ord(c), ord(c)) for c in ".,;:!?"])
WORD = ~(CUT | byte_class([(0x09, 0x09), (0x20, 0x20)]))
PIECE = 1 << 20
LEAST_BITS, MOST_BITS = 20, 28
COUNTED = "fp long, lang string, n long"
PHRASED = "lang string, k int, phrase string, n long, doc long, at long"
_K = np.uint64(0x9FB21C651E98DF25)
UNKNOWN = "und"


class _Batch:
    """Words of some texts, and the n-grams that stay inside a piece."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lang: np.ndarray):
        self.low = LOWER[data]
        self.start, self.end, self.row = spans(WORD[self.low], at)
        cuts = np.concatenate([[0], np.cumsum(CUT[self.low])])
        self.piece = cuts[self.start] if len(self.start) else self.start
        self.lang = lang[self.row]
        self.hash = word_hash(self.low, self.start, self.end)

    def inside(self, k: int) -> np.ndarray:
        n = max(0, len(self.start) - k + 1)
        last = slice(k - 1, k - 1 + n)
        return (self.row[:n] == self.row[last]) & (self.piece[:n] == self.piece[last])

    def fingerprints(self, k: int) -> np.ndarray:
        """Of each n-gram; the two lowest bits hold its length less one."""
        h = mix(window_hash(self.hash, k) ^ self.lang[:max(0, len(self.hash) - k + 1)])
        return h & ~np.uint64(3) | np.uint64(k - 1)


def _lang_keys(column) -> tuple[np.ndarray, list[str]]:
    """A hash for the language of each row, and their names."""
    names = [UNKNOWN if x is None else x for x in column.to_pylist()]
    known = {x: np.frombuffer(x.encode(), np.uint8) for x in set(names)}
    key = {x: word_hash(v, np.array([0]), np.array([len(v)]), 1)[0] for x, v in known.items()}
    return np.array([key[x] for x in names], np.uint64), names


def _tallied(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and how often each occurs."""
    fp = np.sort(fp)
    edge = np.flatnonzero(np.append(True, fp[1:] != fp[:-1])) if len(fp) else np.zeros(0, np.int64)
    return fp[edge], np.diff(np.append(edge, len(fp)))


def _told(bits: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Whether the table holds a fingerprint's bit."""
    slot = mix(fp) & np.uint64(len(bits) * 64 - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _counted(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], pairs) -> Iterator[pa.RecordBatch]:
    bits = pairs.value if pairs is not None else None
    for b in batches:
        key, names = _lang_keys(b.column(1))
        for lo, hi, data, at in pieces(*bytes_of(b.column(0)), PIECE):
            found = _Batch(data, at, key[lo:hi])
            grams = []
            kept = found.inside(2) & _told(bits, found.fingerprints(2)) if bits is not None else None
            for k in sizes:
                keep = found.inside(k)
                for j in range(k - 1 if kept is not None else 0):
                    keep &= kept[j:j + len(keep)]
                grams.append(found.fingerprints(k)[keep])
            fp, n = _tallied(np.concatenate(grams))
            if len(fp):
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.nulls(len(fp), pa.string()), pa.array(n)], ["fp", "lang", "n"])
            if 1 in sizes and len(found.row):
                n = np.bincount(found.row, minlength=hi - lo)
                of: dict[str, int] = {}
                for name, x in zip(names[lo:hi], n.tolist()):
                    of[name] = of.get(name, 0) + x
                yield pa.RecordBatch.from_arrays([pa.nulls(len(of), pa.int64()), pa.array(list(of)), pa.array(list(of.values()), pa.int64())], ["fp", "lang", "n"])


def _phrased(batches: Iterator[pa.RecordBatch], stayed) -> Iterator[pa.RecordBatch]:
    bits = stayed.value
    for b in batches:
        key, names = _lang_keys(b.column(1))
        doc = b.column(2).to_numpy(zero_copy_only=False)
        for lo, hi, data, at in pieces(*bytes_of(b.column(0)), PIECE):
            found = _Batch(data, at, key[lo:hi])
            if not len(found.row):
                continue
            size = found.end - found.start
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(found.low[WORD[found.low]])])
            words = words.dictionary_encode()
            code, words = words.indices.to_numpy().astype(np.int64), words.dictionary
            tongue, of = np.unique(found.lang, return_inverse=True)
            first = np.searchsorted(found.row, np.arange(hi - lo))
            name = {}
            for x, i in zip(names[lo:hi], first.tolist()):
                if i < len(of):
                    name.setdefault(key[lo + found.row[i]], names[lo + found.row[i]])
            for k in range(1, MOST_WORDS + 1):
                place = np.flatnonzero(found.inside(k))
                place = place[_told(bits, found.fingerprints(k)[place])]
                if not len(place):
                    continue
                # the exact words decide, not the fingerprint
                columns = [of[place], *(code[place + j] for j in range(k))]
                order = np.lexsort(columns[::-1])
                new = np.zeros(len(order), bool)
                new[0] = True
                for x in columns:
                    new[1:] |= x[order][1:] != x[order][:-1]
                edge = np.flatnonzero(new)
                n, at_ = np.diff(np.append(edge, len(order))), place[order[edge]]
                parts = [words.take(pa.array(code[at_ + j])) for j in range(k)]
                phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
                lang = pa.array([name[t] for t in tongue]).take(pa.array(of[at_]))
                yield pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(n), k, np.int32)), phrase.cast(pa.large_string()).cast(pa.string()), pa.array(n),
                                                  pa.array(doc[lo + found.row[at_]]), pa.array(found.start[at_] - at[found.row[at_]])], ["lang", "k", "phrase", "n", "doc", "at"])


def _bit_table(fps: DataFrame, count: int) -> np.ndarray:
    """One bit for each fingerprint, set by Spark; of 2**LEAST_BITS to 2**MOST_BITS bits (32 MB)."""
    size = min(MOST_BITS, max(LEAST_BITS, int(16 * count + 1).bit_length()))
    slots = fps.mapInArrow(lambda it: _slots(it, size), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << size - 6, np.int64)
    table[slots.column("at").to_numpy()] = slots.column("bits").to_numpy()
    return table.view(np.uint64)


def _slots(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        slot = mix(b.column(0).to_numpy().view(np.uint64)) & np.uint64((1 << size) - 1)
        bits = np.uint64(1) << (slot & np.uint64(63))
        yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array(bits.view(np.int64))], ["at", "bits"])


def frequent(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f, place) of all phrases of one to four words seen `least` times in a language, and (lang, n) of all words.

    `place` points to the first occurrence: document and byte.
    """
    spark = prepare(docs.sparkSession)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long"))
    texts = docs.select("text", F.col("lang").cast("string").alias("lang"), doc.alias("doc"))

    def staying(sizes: tuple[int, ...], pairs, name: str) -> DataFrame:
        rows = texts.select("text", "lang").mapInArrow(lambda it: _counted(it, sizes, pairs), COUNTED)
        total = rows.groupBy("fp", "lang").agg(F.sum("n").alias("n"))
        return materialised(total.filter((F.col("n") >= least) | F.col("fp").isNull()), name)

    short = staying((1, 2), None, "short-fingerprints")
    pairs = short.filter("fp is not null and fp & 3 = 1").select("fp")
    bits = spark.sparkContext.broadcast(_bit_table(pairs, pairs.count()))
    long = staying((3, 4), bits, "long-fingerprints")
    stayed = short.filter("fp is not null").select("fp").unionByName(long.filter("fp is not null").select("fp"))
    bits = spark.sparkContext.broadcast(_bit_table(stayed, stayed.count()))
    found = texts.mapInArrow(lambda it: _phrased(it, bits), PHRASED).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f"), F.min(F.struct("doc", "at")).alias("place"))
    real = F.struct(F.when(F.col("place.doc") != NO_ID, F.col("place.doc")).alias("doc_id"), F.col("place.at").alias("at"))
    return materialised(found.filter(F.col("f") >= least).withColumn("place", real), "phrases"), short.filter("fp is null").select("lang", "n")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, k, phrase, place, a, l, r, score) of all phrases of two words or more, by their weakest cut."""
    words = F.split("phrase", " ")
    cuts = (phrases.filter("k > 1").select("lang", "k", "phrase", "place", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
            .select("lang", "k", "phrase", "place", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left"),
                    F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right")))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    cuts = cuts.withColumn("score", F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r)"))
    return (cuts.groupBy("lang", "phrase", "k", "a", "place").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
            .select("lang", "k", "phrase", "place", "a", "best.l", "best.r", "best.score"))


def contained(phrases: DataFrame, share: int = 80) -> DataFrame:
    """(lang, phrase) of those that a longer phrase holds in at least `share` percent of their occurrences."""
    words = F.split("phrase", " ")
    parts = (phrases.filter("k > 2").select("lang", "f", "k", words.alias("w"), F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
             .select("lang", "f", "w", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at"))
             .select("lang", "f", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase")))
    longer = parts.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    held = phrases.join(longer, ["lang", "phrase"])
    return held.filter(F.col("most").cast("decimal(20, 0)") * 100 >= F.col("f").cast("decimal(20, 0)") * share).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = 30, share: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, place): each language's `top` phrases by score."""
    phrases, total = frequent(docs, least)
    found = scored(phrases).join(contained(phrases, share), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "place")
