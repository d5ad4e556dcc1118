"""Token counts by heap-and-linked-list byte-pair merging, without building any token.

A word starts as its bytes in a linked list. A heap holds the adjacent pairs that have a merge rank;
the lowest rank, leftmost first, is popped and merged until none is left. The count is the number of
bytes less the merges. Each worker keeps the counts of words it has seen, up to a fixed number.

Defined cases: null or empty text has no tokens; strings of the vocabulary's special tokens count
as one token each, as the tokenizer's default has it; very long words cost n log n. Other columns
are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.text import prepare

KEPT_WORDS = 400_000
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_symbols() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def load(path: str) -> dict:
    """Start symbols, ranked pairs and special strings of a byte-level BPE file."""
    spec = json.load(open(path, encoding="utf-8"))
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
    ranks: dict[int, int] = {}
    for rank, (a, b) in enumerate(merges):
        ranks.setdefault(vocab[a] << 32 | vocab[b], rank)
    return {"start": [vocab[c] for c in byte_symbols()], "ranks": ranks, "made": [vocab[a + b] for a, b in merges],
            "special": [t["content"] for t in spec["added_tokens"] if t["special"]]}


def merged_count(symbols: list[int], ranks: dict[int, int], made: list[int]) -> int:
    """Symbols left after all merges."""
    n = len(symbols)
    if n < 2:
        return n
    heap = []
    for i in range(n - 1):
        rank = ranks.get(symbols[i] << 32 | symbols[i + 1])
        if rank is not None:
            heap.append(rank << 32 | i)
    if not heap:
        return n
    heapify(heap)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    merges = 0
    while heap:
        top = heappop(heap)
        rank, i = top >> 32, top & 0xFFFFFFFF
        j = right[i]
        if symbols[i] < 0 or j >= n or ranks.get(symbols[i] << 32 | symbols[j]) != rank:
            continue
        symbols[i], symbols[j] = made[rank], -1
        merges += 1
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            rank = ranks.get(symbols[i] << 32 | symbols[k])
            if rank is not None:
                heappush(heap, rank << 32 | i)
        k = left[i]
        if k >= 0:
            rank = ranks.get(symbols[k] << 32 | symbols[i])
            if rank is not None:
                heappush(heap, rank << 32 | k)
    return n - merges


class _Counter(dict):
    """Counts by word; a missing word is merged when first asked for."""

    def __init__(self, model: dict):
        super().__init__()
        self.start, self.ranks, self.made = model["start"], model["ranks"], model["made"]

    def __missing__(self, word: str) -> int:
        start = self.start
        n = merged_count([start[b] for b in word.encode()], self.ranks, self.made)
        if len(word) <= 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


def _count(batches: Iterator[pa.RecordBatch], model, pattern: str, limit: int) -> Iterator[pa.RecordBatch]:
    import regex

    counter = model.value.get("counter")
    if counter is None:
        counter = model.value["counter"] = _Counter(model.value)
    words = regex.compile(pattern).findall
    special = model.value["special"]
    cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))).split if special else None
    for b in batches:
        n_bytes, n_tokens = [], []
        for text in b.column(1).to_pylist():
            text = text or ""
            parts = cut(text) if cut else [text]
            n = len(parts) - 1
            for part in parts:
                n += sum(map(counter.__getitem__, words(part)))
            n_bytes.append(len(text.encode()))
            n_tokens.append(n)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                                          pa.array([n > limit for n in n_tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def count_tokens(docs: DataFrame, tokenizer: str, pattern: str, limit: int = 512) -> DataFrame:
    """Bytes and tokens of every text; `tokenizer` is a byte-level BPE file, `pattern` its word pattern."""
    spark = prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast(load(tokenizer))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _count(it, model, pattern, limit), COUNTS)
