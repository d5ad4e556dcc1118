"""Dedup and decontamination against plain versions, over documents with all odd cases."""

import random
import tracemalloc

import numpy as np
import pytest

from tests.llm import plain
from tidewatch.llm import bag_minhash, blocks, components, decontaminate, line_dedup, run_index, substring_dedup, suffix_dedup
from tidewatch.llm.text import PIECE_BYTES


def same(df, want):
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == sorted((tuple(w) for w in want), key=repr)


@pytest.fixture(scope="module")
def pairs():
    return plain.rows()


@pytest.fixture(scope="module")
def docs(spark, pairs):
    return plain.frame(spark, pairs).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return plain.frame(spark, [])


def test_suffix_dedup(docs, pairs):
    same(suffix_dedup.digests(docs), plain.suffixes(pairs))


def test_suffix_dedup_of_common_passages(docs, pairs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    same(suffix_dedup.digests(docs), plain.suffixes(pairs))


def _bucket_messages(block_texts, n=1):
    """The messages that blocks, each of one text, send to each index bucket of suffix_dedup; texts' ids are their places."""
    rows = [(np.frombuffer(t, np.uint8), np.array([0, len(t)]), np.array([i])) for i, t in enumerate(block_texts)]
    seeds = [dict(suffix_dedup._seeds(*r, 50, n))[0] for r in rows]
    alive = blocks.repeated_anchors(suffix_dedup.HOT)(seeds)
    buckets = {}
    for r, reply in zip(rows, alive):
        for bucket, payload in suffix_dedup._send(*r, {1: [reply]}, 50, n):
            buckets.setdefault(bucket, []).append(payload)
    return buckets


def _told(replies):
    """Each reply as sorted (hashes, first windows, earliest documents) of its segments."""
    out = []
    for reply in replies:
        a, b, n, run_from, run_doc = blocks.unpacked(reply, np.uint64, np.uint64, np.uint8, np.uint8, np.int64) if reply else ([], [], [], [], [])
        at = np.cumsum(np.append(0, n).astype(int))
        out.append(sorted((int(x), int(y), run_from[i:j].tolist(), run_doc[i:j].tolist()) for x, y, i, j in zip(a, b, at[:-1], at[1:])))
    return out


def test_suffix_index_memory_does_not_grow_with_the_bucket():
    """A bucket of many segments is indexed part by part (some 60 MB here at most); one index of all took 355 MB."""
    passage = np.random.default_rng(4).integers(97, 123, 2_000_000).astype(np.uint8).tobytes()
    payloads = _bucket_messages([passage, b"own " + passage])[0]
    tracemalloc.start()
    replies = list(suffix_dedup._match(payloads, 50))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6, f"{peak / 1e6:.0f} MB"
    assert not replies[0] and all(docs == [0] for *_, docs in _told(replies)[1])


def test_suffix_index_parts_tell_what_one_index_tells(monkeypatch):
    rnd = random.Random(5)
    lines = ["".join(rnd.choice("ab cde") for _ in range(rnd.randint(40, 160))) for _ in range(60)]
    texts = [" ".join(rnd.choices(lines, k=40)).encode() for _ in range(12)]
    for payloads in _bucket_messages(texts).values():
        whole = _told(suffix_dedup._match(payloads, 50))
        for limit in (1, 2_000):
            monkeypatch.setattr(suffix_dedup, "INDEX_BYTES", limit)
            assert _told(suffix_dedup._match(payloads, 50)) == whole
        monkeypatch.undo()


def test_blocks_follow_the_bytes_of_the_texts(spark):
    rows = [(i, "é" * 500) for i in range(100)] + [(100, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert blocks.Exchange(docs, 2_000).n == 50 and blocks.Exchange(docs, 1 << 24).n == blocks.Exchange(docs).n == 16
    assert blocks.Exchange(docs.limit(0), 2_000).n == 16
    same(suffix_dedup.digests(docs), plain.suffixes(rows))


def test_suffix_dedup_of_more_blocks_than_partitions(docs, pairs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 4_000)
    assert blocks.Exchange(docs, 4_000).n > 16
    same(suffix_dedup.digests(docs), plain.suffixes(pairs))


def test_substring_dedup(docs, pairs):
    same(substring_dedup.digests(docs), plain.substrings(pairs))


def test_texts_longer_than_a_piece(spark):
    """A text of more than PIECE_BYTES, and more texts than one piece holds: passages at both ends of the long one and behind its first piece."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    long = [word() for _ in range(PIECE_BYTES // 7 + 3000)]
    cut = lambda at, n: " ".join(long[at:at + n])
    there = PIECE_BYTES // 7
    rows = [(5, " ".join(long)), (9, f"{word()} {cut(0, 60)} {word()}"), (2, f"{cut(there - 40, 90)} {word()}"), (7, cut(len(long) - 55, 55)),
            (3, cut(100, 49)), *((20 + i, " ".join(word() for _ in range(400))) for i in range(4)), (30, cut(there + 200, 70))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(suffix_dedup.digests(docs), plain.suffixes(rows))
    same(substring_dedup.digests(docs), plain.substrings(rows))


@pytest.mark.parametrize("n", [1, 2, 3, 24, 25, 26, 48, 49, 50, 51])
def test_tables_of_few_words(spark, n):
    """Blocks that hold fewer words than one window, or just one window."""
    rows = [(1, " ".join(f"w{i}" for i in range(n)))]
    for some in (rows, rows + [(2, rows[0][1])]):
        docs = spark.createDataFrame(some, "doc_id long, text string")
        same(substring_dedup.digests(docs), plain.substrings(some))
        same(suffix_dedup.digests(docs), plain.suffixes(some))


def test_line_dedup(docs, pairs):
    want = list(plain.lines(pairs))
    same(line_dedup.digests(docs), [(i, n, k, plain.sha(t)) for i, n, k, t in want])
    left = line_dedup.remove(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in left.collect()), key=repr) == sorted(((i, t) for i, _, _, t in want), key=repr)


def test_line_runs_over_task_borders(spark):
    line = "a line that very many documents hold, over and over again"
    pairs = [(i, f"{line}\n{line}\nown {i}") for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        same(line_dedup.digests(plain.frame(spark, pairs)), [(i, n, k, plain.sha(t)) for i, n, k, t in plain.lines(pairs)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("most", [300_000, 7])
def test_decontaminate(spark, docs, pairs, most):
    text = next(t for _, t in pairs if t and len(plain.words(t)) > 60)
    w = plain.words(text)
    items = [(1, " ".join(w[5:40]).upper()), (20, "; ".join(w[30:48])), (3, w[0] + " " + w[1]), (4, None), (5, "?!"), (None, text), (1, "same id again"), (6, text)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    same(decontaminate.digest(decontaminate.mark(docs, benchmark, max_windows=most)), plain.leaks(pairs, items))
    clean = {i for i, *_, hit in plain.leaks(pairs, items) if not hit}
    left = decontaminate.clean_documents(docs, benchmark)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} <= clean | {None}


def test_hit_bytes(spark):
    docs = spark.createDataFrame([(1, "Für: one, TWO three. end")], "doc_id long, text string")
    found = decontaminate.mark(docs, spark.createDataFrame([(9, "one two three")], "item_id long, text string")).first()
    assert "Für: one, TWO three. end".encode()[slice(*found.hit_bytes)] == b"one, TWO three" and found.items == ["9"]


def test_near_groups(docs, pairs):
    ids = [i for i, _ in pairs]
    single = [(i, t) for i, t in pairs if ids.count(i) == 1 or i is not None]
    got = {r.doc_id: r.group_id for r in bag_minhash.groups(docs.filter("doc_id is not null")).collect()}
    assert got == plain.near_groups([p for p in single if p[0] is not None])
    stay = bag_minhash.keep_one(docs)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} >= set(got.values())


def test_near_groups_of_shared_and_null_ids(spark):
    r = random.Random(8)
    prose = lambda: [f"w{r.randrange(10**6)}" for _ in range(120)]
    near = lambda x: " ".join([*x[:60], "new", *x[61:]])
    a, b, c = prose(), prose(), prose()
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(b)), (3, near(a)), (None, near(c)), (None, " ".join(c)), (9, " ".join(c)), (None, " ".join(prose())), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x.doc_id, x.group_id) for x in bag_minhash.groups(docs).collect()), key=repr)
    assert got == sorted(plain.near_rows(rows), key=repr)
    kept = sorted(((x.doc_id, x.text) for x in bag_minhash.keep_one(docs).collect()), key=repr)
    one_of_c = [x for x in kept if x[1] in (" ".join(c), near(c))]
    assert len(one_of_c) == 1 and one_of_c[0][0] is None
    assert sorted(set(kept) - set(one_of_c), key=repr) == sorted([rows[0], rows[1], *rows[7:]], key=repr)


def patterned(n=1024):
    """A word in Thue-Morse order over two letters, and its complement."""
    one = "a"
    while len(one) < n:
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_patterned_words_stay_apart(spark):
    one, two = patterned()
    rows = [(1, " ".join([one] * 60)), (2, " ".join([two] * 60)), (3, " ".join([one, two] * 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(substring_dedup.digests(docs), plain.substrings(rows))
    assert {x.doc_id: x.group_id for x in bag_minhash.groups(docs).collect()} == plain.near_groups(rows)


def family(kind, n):
    """Texts of one template with twins, or texts put together from a small stock of phrases."""
    r = random.Random(n)
    stock = [" ".join(f"p{k}x{r.randrange(10**6)}" for _ in range(12)) for k in range(40)]
    if kind == "letters":
        return [(i, " ".join(r.choice(stock) for _ in range(20))) for i in range(n)]
    return twins(n // 2, n)


@pytest.mark.parametrize("kind", ["twins", "letters"])
def test_pairs_to_verify_follow_the_documents(spark, kind, monkeypatch):
    made = []
    whole = bag_minhash.verified

    def counted(pairs, *rest):
        made.append(pairs.count())
        return whole(pairs, *rest)

    monkeypatch.setattr(bag_minhash, "verified", counted)
    total = {}
    for n in (100, 400):
        made.clear()
        pairs = family(kind, n)
        found = bag_minhash.groups(spark.createDataFrame(pairs, "doc_id long, text string")).collect()
        assert n > 100 or {x.doc_id: x.group_id for x in found} == plain.near_groups(pairs)
        total[n] = sum(made)
    assert total[400] < 40 * 400 and total[400] < 10 * max(total[100], 100)


def twins(n_pairs, seed, both=28):
    """Texts of one template at 0.76 to one another, and each near its one twin by `both` words more."""
    r = random.Random(seed)
    own = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
    template, out = own(516), []
    for _ in range(n_pairs):
        shared, mine = own(both), []
        for _ in range(2):
            mine.append(" ".join(template + shared + own(80 - both)))
        out += mine
    r.shuffle(out)
    return list(enumerate(out))


def test_twins_split_between_chunks_meet(spark, monkeypatch):
    monkeypatch.setattr(bag_minhash, "CHUNK", 4)
    monkeypatch.setattr(bag_minhash, "CENTRAL", 1)
    pairs = twins(60, 5)
    found = bag_minhash.groups(spark.createDataFrame(pairs, "doc_id long, text string")).collect()
    want = plain.near_groups(pairs)
    assert len(set(want.values())) == 60 and {r.doc_id: r.group_id for r in found} == want


def test_twins_among_many_neighbours_meet(spark):
    pairs = twins(150, 6, 20)
    found = bag_minhash.groups(spark.createDataFrame(pairs, "doc_id long, text string")).collect()
    twin = {}
    for i, t in pairs:
        twin.setdefault(t.split(" ")[516], []).append(i)
    assert all(len(x) == 2 for x in twin.values()) and {r.doc_id: r.group_id for r in found} == {i: min(x) for x in twin.values() for i in x}


def test_large_buckets_keep_their_common_origin(spark, monkeypatch):
    """Copies of one text that are near it and far from one another, in buckets of many chunks."""
    monkeypatch.setattr(bag_minhash, "CHUNK", 12)
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base)]
    for _ in range(60):
        near = list(base)
        for p in r.sample(range(400), 8):
            near[p] = f"new{r.randrange(10**6)}"
        texts.append(" ".join(near))
    found = bag_minhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x.group_id for x in found} == {0}


def test_weighted_signatures_are_unbiased():
    r = np.random.default_rng(1)
    key = r.integers(0, 1 << 63, 60).astype(np.uint64)
    a, b = r.integers(1, 40, 60), r.integers(1, 40, 60)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    row = np.zeros(60, np.int64)
    one, two = (bag_minhash.signatures(row, key, w, 1, 4000)[0] for w in (a, b))
    assert abs((one == two).mean() - want) < 4 * (want * (1 - want) / 4000) ** 0.5


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {x.node: x.root for x in found.collect()} == plain.roots(nodes, [e for e in edges if e[0] != e[1]])


def test_run_index_tells_the_earliest_document():
    r = random.Random(4)
    texts = sorted({bytes(r.choice(b"ab\x00\xff") for _ in range(r.randint(8, 30))) for _ in range(60)})
    doc = np.sort(np.array([r.randrange(20) for _ in texts]))
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = [min(int(d) for t, d in zip(texts, doc) if text[i:i + 5] in t) for text in texts for i in range(len(text) - 4)]
    assert run_index.RunIndex(data, at, doc, 5).earliest().tolist() == want


def test_packed_round_trip():
    a, b = np.arange(5, dtype=np.uint64), np.zeros(0, np.uint8)
    x, y = blocks.unpacked(blocks.packed(a, b), np.uint64, np.uint8)
    assert x.tolist() == a.tolist() and len(y) == 0


def test_empty_tables(spark, nothing):
    empty = spark.createDataFrame([], "item_id long, text string")
    for df in (suffix_dedup.digests(nothing), substring_dedup.digests(nothing), line_dedup.digests(nothing), line_dedup.remove(nothing),
               bag_minhash.groups(nothing), bag_minhash.keep_one(nothing), decontaminate.mark(nothing, empty)):
        assert df.count() == 0
    one = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    assert decontaminate.digest(decontaminate.mark(one, empty)).first()[1:4] == (3, 0, 0)


def test_located_tells_equal_first_halves_apart():
    a, b = np.array([1, 1, 1, 5, 9, 9], np.uint64), np.array([2, 4, 7, 1, 3, 8], np.uint64)
    hit, where = blocks.located(np.array([1, 1, 1, 5, 9, 9, 10, 0], np.uint64), np.array([7, 2, 5, 1, 8, 9, 1, 1], np.uint64), a, b)
    assert hit.tolist() == [True, True, False, True, True, False, False, False] and where[hit].tolist() == [2, 0, 3, 5]


def test_plans_hold_no_cross_join(docs, spark):
    benchmark = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    for df in (suffix_dedup.digests(docs), substring_dedup.digests(docs), line_dedup.digests(docs), bag_minhash.keep_one(docs),
               decontaminate.clean_documents(docs, benchmark)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
