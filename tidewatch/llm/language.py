"""Language identification by compression.

Every learned language has a zstandard raw-content dictionary of its own words. A text (lower case,
letters only, a word that repeats itself kept once) is compressed in blocks with each dictionary;
blocks keep the dictionary ahead of what the text itself teaches. The smallest total wins; if the
runner-up is nearly as small the text is rejected. Texts too short to be compressed at all follow a
fixed string that all dictionaries end with, so that the coder doesn't fall back to storing them.

Fitting uses a bounded sample: `sample_docs` labelled texts a language, `sample_chars` characters of
each, `dict_bytes` of dictionary. A first set of dictionaries throws out sample texts that look
wrongly labelled. Prediction reads whole texts and nothing but the text.

Defined cases: null text, or text without a letter (signs such as a raised two are none), is `und`, score 0, rejected; so is every text
if nothing was learned; equal sizes go to the language first by name, score 0, rejected. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.text import prepare

_LETTERS = re.compile(r"[^\W\d_]+").findall
BLOCK, LEVEL = 1024, 6
SHORT, SHORT_LEVEL = 256, 12
CARRIER = b"".join(hashlib.sha256(bytes([i])).hexdigest().encode() for i in range(2))
PREDICTED = "doc_id long, lang_pred string, score double, margin double, rejected boolean"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def plain(text: str) -> bytes:
    return " ".join([w for w, _ in groupby(_LETTERS(text.lower()))]).encode()


class Sizer:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        def coder(content: bytes, level: int):
            content = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            return zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False,
                                            write_checksum=False, write_dict_id=False).compress

        self.names = sorted(dictionaries)
        self.coders = [coder(dictionaries[n] + CARRIER, LEVEL) for n in self.names]
        self.short_coders = [coder(dictionaries[n] + CARRIER, SHORT_LEVEL) for n in self.names]

    def predict(self, text: str | None, narrow: float) -> tuple[str, float, float, bool]:
        data = plain(text or "")
        if not data or not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0, True
        if len(data) < SHORT:
            sizes = [len(code(CARRIER + data)) for code in self.short_coders]
        else:
            blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
            sizes = [sum(map(len, map(code, blocks))) for code in self.coders]
        best = min(sizes)
        name = self.names[sizes.index(best)]
        if len(sizes) == 1:
            return name, 1.0, 1.0, False
        margin = 1 - best / sorted(sizes)[1]
        return name, margin / (margin + max(narrow, 0.01)), margin, margin < narrow or margin == 0


def _pack(texts: list[str], dict_bytes: int) -> bytes:
    out, size = [], 0
    for text in texts:
        if size >= dict_bytes:
            break
        out.append(plain(text))
        size += len(out[-1]) + 1
    return b" ".join(out)[:dict_bytes]


def fit(labelled: DataFrame, sample_docs: int = 200, sample_chars: int = 4000, dict_bytes: int = 1 << 16) -> dict[str, bytes]:
    """Dictionaries by language from rows of (doc_id, text, lang)."""
    chosen = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = (labelled.filter("lang is not null and text is not null").select("doc_id", "lang", F.substring("text", 1, sample_chars).alias("text"))
            .withColumn("_at", F.row_number().over(chosen)).filter(F.col("_at") <= sample_docs).collect())
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: r["_at"]):
        if plain(r["text"]):
            texts.setdefault(r["lang"], []).append(r["text"])
    if not texts:
        return {}
    first = Sizer({lang: _pack(own, dict_bytes) for lang, own in texts.items()})
    clean = {lang: [x for x in own if first.predict(x, 0.0)[0] == lang] or own for lang, own in texts.items()}
    return {lang: _pack(own, dict_bytes) for lang, own in clean.items()}


def _predict(batches: Iterator[pa.RecordBatch], dictionaries, narrow: float) -> Iterator[pa.RecordBatch]:
    sizer = Sizer(dictionaries.value)
    for b in batches:
        got = [sizer.predict(text, narrow) for text in b.column(1).to_pylist()]
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds)],
                                         ["doc_id", "lang_pred", "score", "margin", "rejected"])


def predict(docs: DataFrame, dictionaries: dict[str, bytes], narrow: float = 0.01) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected); rejected if the runner-up is within the share `narrow`."""
    sent = prepare(docs.sparkSession).sparkContext.broadcast(dictionaries)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _predict(it, sent, narrow), PREDICTED)


def identify(docs: DataFrame, narrow: float = 0.01) -> DataFrame:
    """Learn from what is not held out, predict every document."""
    found = predict(docs, fit(docs.filter(~held_out(F.col("doc_id")))), narrow)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def _accepted(batches: Iterator[pa.RecordBatch], dictionaries, narrow: float) -> Iterator[pa.RecordBatch]:
    sizer = Sizer(dictionaries.value)
    for b in batches:
        stay = [not sizer.predict(text, narrow)[3] for text in b.column(b.schema.get_field_index("text")).to_pylist()]
        yield b.filter(pa.array(stay, pa.bool_()))


def keep_identified(docs: DataFrame, narrow: float = 0.01) -> DataFrame:
    """The documents that are not rejected, all columns kept."""
    learned = fit(docs.filter(~held_out(F.col("doc_id"))))
    sent = prepare(docs.sparkSession).sparkContext.broadcast(learned)
    return docs.mapInArrow(lambda it: _accepted(it, sent, narrow), docs.schema)
