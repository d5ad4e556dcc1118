"""Encoding into sentence pieces with seeded merge-dropout, and lossless decoding.

A text gets one leading space, spaces become the piece mark, and chunks (a run of marks and what
follows up to the next mark) are segmented by agenda: the best-scored adjacent pair, leftmost first,
is popped and merged if its union is a piece. With dropout a popped candidate is skipped by a keyed
hash of (seed, document, ordinal, place, rank), so every occurrence of a word is cut on its own.
Equal inputs and seed give equal pieces on any cluster.

The agendas of a batch run side by side in numpy (`Agenda`): the symbols of all chunks are one array, and
in each round every chunk pops its best candidate, all keyed hashes are tested at once, and pairs merge or
are struck out. Nothing is remembered between words, so the cost follows the characters, not the
vocabulary. Chunks of more than LONG characters use a heap each, with equal results (`segment`).

Defined cases: null or empty text has no pieces; characters without a piece, and a piece mark in
the text itself, become byte pieces; a text of any length is one row, segmented chunk by chunk; rows with one
doc_id and text get equal pieces; an empty table gives no rows; decoding gives back every text exactly
(null decodes as empty). Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.text import mix, prepare

MARK, HELD = "▁", 0xD800  # HELD stands for a mark in the text: no text can hold this code point
LONG, BATCH_CHARS = 64, 1 << 20
PLACE_BITS, NONE = 7, np.uint32(0xFFFFFFFF)
_M = (1 << 64) - 1
_C = np.uint64(0x9E3779B97F4A7C15)


def load(path: str) -> dict:
    """Pieces with ids and scores, and the byte pieces, of a BPE model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, rank, raw, first_byte = {}, {}, [], None
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            first_byte = i if first_byte is None else first_byte
            raw.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            raw.append(b"")
        else:
            ids[piece] = i
            rank[piece] = -model.get_score(i)
            raw.append(piece.replace(MARK, " ").encode())
    order = {p: k for k, p in enumerate(sorted(rank, key=lambda p: (rank[p], ids[p])))}
    level: dict[float, int] = {}
    for p in sorted(rank, key=rank.get):
        level.setdefault(rank[p], order[p])
    found = {"ids": ids, "rank": {p: level[rank[p]] for p in rank}, "raw": raw, "byte": first_byte, "lines": not any("\n" in p for p in ids)}
    return found | {"agenda": agenda_tables(found)}


def _fold(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _M
    return x ^ (x >> 31)


def skips(seed: int, dropout: float) -> np.ndarray:
    """One flag for each value of a 16-bit keyed hash; about `dropout` of them are set."""
    drawn = mix(np.uint64(_fold(seed * 0x9E3779B97F4A7C15 & _M)) + np.arange(1 << 16, dtype=np.uint64))
    return drawn.astype(np.float64) < dropout * 2.0**64


def segment(chunk: str, rank: dict[str, int], skipped: Callable[[int], bool]) -> list[str]:
    """Pieces of one chunk by a heap of candidates (rank << 32 | place)."""
    part = list(chunk)
    n = len(part)
    if n < 2:
        return part
    heap = []
    for i in range(n - 1):
        r = rank.get(part[i] + part[i + 1])
        if r is not None:
            heap.append(r << 32 | i)
    if not heap:
        return part
    heapify(heap)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        top = heappop(heap)
        r, i = top >> 32, top & 0xFFFFFFFF
        j = right[i]
        if not part[i] or j >= n:
            continue
        both = part[i] + part[j]
        if rank.get(both) != r or skipped(top):
            continue
        part[i], part[j] = both, ""
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            r = rank.get(both + part[k])
            if r is not None:
                heappush(heap, r << 32 | i)
        k = left[i]
        if k >= 0:
            r = rank.get(part[k] + both)
            if r is not None:
                heappush(heap, r << 32 | k)
    return [p for p in part if p]


def agenda_tables(model: dict) -> dict:
    """Symbols (pieces and single characters of pieces), and a hash table of the pairs whose union is a piece."""
    rank = model["rank"]
    symbol = {p: k for k, p in enumerate(rank)}
    for p in rank:
        for c in p:
            symbol.setdefault(c, len(symbol))
    n = len(symbol) + 1  # the last one stands for all other characters
    pairs = {symbol[p[:k]] * n + symbol[p[k:]]: (rank[p], symbol[p]) for p in rank for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol}
    size = 1 << max(4, (6 * len(pairs)).bit_length())
    key, value, made = np.array(list(pairs), np.int64), np.array([r for r, _ in pairs.values()], np.uint32), np.array([m for _, m in pairs.values()], np.int32)
    table, of = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    left, step = np.arange(len(key)), 0
    while len(left):
        slot = _slot(key[left], step, size)
        free = table[slot] < 0
        slot_, first = np.unique(slot[free], return_index=True)
        chosen = left[free][first]
        table[slot_], of[slot_] = key[chosen], chosen
        left, step = np.setdiff1d(left, chosen), step + 1
    chars = np.full(0x110000, n - 1, np.int32)
    for p, k in symbol.items():
        if len(p) == 1:
            chars[ord(p)] = k
    ids = np.array([model["ids"].get(p, -1) for p in symbol] + [-1], np.int32)
    return {"n": n, "table": table, "rank": np.append(value, NONE)[of], "made": np.append(made, 0)[of].astype(np.int32), "steps": step, "chars": chars, "ids": ids, "symbol": symbol}


def _slot(key: np.ndarray, step: int, size: int) -> np.ndarray:
    return ((key.astype(np.uint64) * _C >> np.uint64(24)).astype(np.int64) + step) & (size - 1)


class Agenda:
    """Segments all chunks of a batch at once, each occurrence with its own dropout."""

    def __init__(self, model: dict, seed: int, dropout: float):
        self.model, self.seed = model, seed
        self.flags = skips(seed, dropout) if dropout else None
        self.t = model["agenda"]
        self.line = ord("\n") if model["lines"] else -1

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, union) of pairs of symbols; NONE if their union is no piece."""
        t = self.t
        key = left.astype(np.int64) * t["n"] + right
        slot = _slot(key, 0, len(t["table"]))
        seen = t["table"][slot]
        rank, made = t["rank"][slot], t["made"][slot]
        rank[seen != key] = NONE
        todo = np.flatnonzero((seen != key) & (seen >= 0))
        for step in range(1, t["steps"]):
            if not len(todo):
                break
            slot = _slot(key[todo], step, len(t["table"]))
            seen, hit = t["table"][slot], t["table"][slot] == key[todo]
            rank[todo[hit]], made[todo[hit]] = t["rank"][slot[hit]], t["made"][slot[hit]]
            todo = todo[~hit & (seen >= 0)]
        return rank, made

    def _skipped(self, rank: np.ndarray, place: np.ndarray, key: np.ndarray) -> np.ndarray:
        top = rank.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)
        return self.flags[((top ^ key) * _C >> np.uint64(40)) & np.uint64(0xFFFF)]

    def run(self, symbol: np.ndarray, start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, which of them are left) after all merges of chunks of at most LONG characters that begin at `start`."""
        n = len(symbol)
        size = np.diff(np.append(start, n))
        place = (np.arange(n) - np.repeat(start, size)).astype(np.uint32)
        out, left_over = symbol.copy(), np.ones(n, bool)
        more = np.ones(n, np.int16)  # steps to the next symbol of the chunk, 0 if none
        more[start + size - 1] = 0
        back = np.minimum(place, 1).astype(np.int16)
        rank, made = self._pairs(symbol, np.append(symbol[1:], 0))
        order = np.where((more > 0) & (rank != NONE), rank << np.uint32(PLACE_BITS) | place, NONE)
        symbol, alive, at = symbol.copy(), np.ones(n, bool), np.arange(n)
        while len(start):
            best = np.minimum.reduceat(order, start)
            go = best != NONE
            if go.sum() <= 0.75 * len(go):  # chunks without candidates are done
                out[at], left_over[at] = symbol, alive
                keep = np.repeat(go, size)
                symbol, alive, at, more, back, order, made = (x[keep] for x in (symbol, alive, at, more, back, order, made))
                size, key, best = size[go], key[go], best[go]
                start = np.cumsum(size) - size
                go = np.ones(len(size), bool)
                if not len(start):
                    break
            spot, rank = best & np.uint32((1 << PLACE_BITS) - 1), best >> np.uint32(PLACE_BITS)
            i = (start + spot)[go]
            if self.flags is not None:
                struck = self._skipped(rank[go], spot[go], key[go])
                order[i[struck]] = NONE
                i = i[~struck]
            j = i + more[i]
            symbol[i] = both = made[i]
            alive[j], order[j], order[i] = False, NONE, NONE
            on = more[j] > 0
            more[i] = np.where(on, more[i] + more[j], 0)
            k = i[on] + more[i[on]]
            back[k] = more[i[on]]
            prior = back[i] > 0
            h = i[prior] - back[i[prior]]
            # new neighbours: to the right of each union, and to its left
            first = np.concatenate([i[on], h])
            rank, union = self._pairs(symbol[first], np.concatenate([symbol[k], both[prior]]))
            order[first] = np.where(rank != NONE, rank << np.uint32(PLACE_BITS) | place[at[first]], NONE)
            made[first] = union
        out[at], left_over[at] = symbol, alive
        return out, left_over

    def texts(self, texts: list[str], ids: list[int | None]) -> list[np.ndarray]:
        """Piece ids of each text."""
        out, lo, size = [], 0, 0
        for hi, x in enumerate(texts, 1):
            size += len(x)
            if size >= BATCH_CHARS or hi == len(texts):
                out += self._texts(texts[lo:hi], ids[lo:hi])
                lo, size = hi, 0
        return out

    def _texts(self, texts: list[str], doc: list[int | None]) -> list[np.ndarray]:
        length = np.array([len(x) + 1 if x else 0 for x in texts], np.int64)
        ends = np.cumsum(length)
        if not len(ends) or not ends[-1]:
            return [np.zeros(0, np.int32)] * len(texts)
        first = (ends - length)[length > 0]
        mark = ord(MARK)
        code = np.frombuffer("".join([" " + x for x in texts if x]).encode("utf-32-le"), np.uint32).copy()
        code[code == mark] = HELD
        code[code == 32] = mark
        # chunks: a run of marks and what follows; a line end by itself, if no piece holds one
        marked, line = code == mark, code == np.uint32(self.line & 0xFFFFFFFF)
        new = marked | line
        new[1:] &= ~marked[:-1] | line[1:]
        new[1:] |= line[:-1]
        new[first] = True
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(code)))
        of = np.searchsorted(first, start, "right") - 1
        base = np.array([_fold((self.seed * 0x9E3779B97F4A7C15 ^ ((d or 0) & _M)) & _M) for d, x in zip(doc, texts) if x], np.uint64)
        key = mix(base[of] + (np.arange(len(start)) - np.searchsorted(start, first)[of]).astype(np.uint64))
        symbol, left = self.t["chars"][code], np.ones(len(code), bool)
        short = size <= LONG
        at = np.flatnonzero(np.repeat(short, size))
        symbol[at], left[at] = self.run(symbol[at], np.cumsum(size[short]) - size[short], key[short])
        for c in np.flatnonzero(~short):
            self._long(code, symbol, left, int(start[c]), int(start[c] + size[c]), int(key[c]))
        place = np.flatnonzero(left)
        piece = self.t["ids"][symbol[place]]
        n = np.ones(len(place), np.int64)
        raw = np.flatnonzero(piece < 0)
        spelt = [(MARK if c == HELD else chr(c)).encode() for c in code[place[raw]].tolist()]
        n[raw] = [len(x) for x in spelt]
        upto = np.cumsum(n)
        got = np.repeat(piece, n)
        if len(raw):
            got[got < 0] = np.frombuffer(b"".join(spelt), np.uint8).astype(np.int32) + self.model["byte"]
        cuts = np.append(0, upto)[np.searchsorted(place, ends)]
        return np.split(got, cuts[:-1])

    def _long(self, code: np.ndarray, symbol: np.ndarray, left: np.ndarray, lo: int, hi: int, key: int) -> None:
        flags = self.flags
        chunk = code[lo:hi].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        drop = (lambda top: flags[((top ^ key) * 0x9E3779B97F4A7C15 >> 40) & 0xFFFF]) if flags is not None else (lambda top: False)
        left[lo:hi] = False
        for piece in segment(chunk, self.model["rank"], drop):
            left[lo] = True
            if len(piece) > 1:
                symbol[lo] = self.t["symbol"][piece]
            lo += len(piece)


def decode_ids(ids: np.ndarray, raw: list[bytes]) -> str:
    """The text of piece ids."""
    return b"".join(map(raw.__getitem__, ids.tolist()))[1:].decode()


def _encode(batches: Iterator[pa.RecordBatch], model, seed: int, dropout: float, check: bool) -> Iterator[pa.RecordBatch]:
    found, raw = Agenda(model.value, seed, dropout), model.value["raw"]
    for b in batches:
        texts = [x or "" for x in b.column(1).to_pylist()]
        coded = found.texts(texts, b.column(0).to_pylist())
        n = pa.array([len(x) for x in coded], pa.int64())
        if check:
            rest = [pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in coded]), pa.array([decode_ids(p, raw) == x for p, x in zip(coded, texts)], pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), n, *rest], ["doc_id", "n_pieces", "ids_sha256", "lossless"])
        else:
            ends = np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *coded])))
            yield pa.RecordBatch.from_arrays([b.column(0), n, ids], ["doc_id", "n_pieces", "pieces"])


def encode(docs: DataFrame, tokenizer: str, seed: int = 17, dropout: float = 0.1) -> DataFrame:
    """(doc_id, n_pieces, pieces) of every text."""
    model = prepare(docs.sparkSession).sparkContext.broadcast(load(tokenizer))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda it: _encode(it, model, seed, dropout, False), "doc_id long, n_pieces long, pieces array<int>")


def digest(docs: DataFrame, tokenizer: str, seed: int = 17, dropout: float = 0.1) -> DataFrame:
    """Per text: number of pieces, digest of the ids (32-bit, least byte first), whether decoding gives the text back."""
    model = prepare(docs.sparkSession).sparkContext.broadcast(load(tokenizer))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda it: _encode(it, model, seed, dropout, True), "doc_id long, n_pieces long, ids_sha256 string, lossless boolean")


def _decode(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    raw = model.value["raw"]
    for b in batches:
        texts = [decode_ids(np.array(x or [], np.int64), raw) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) of encoded rows."""
    model = prepare(encoded.sparkSession).sparkContext.broadcast(load(tokenizer))
    return encoded.select("doc_id", "pieces").mapInArrow(lambda it: _decode(it, model), "doc_id long, text string")
