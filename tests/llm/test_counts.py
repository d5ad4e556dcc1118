"""Phrases, token files and vector codes against plain versions."""

import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest

from tests.llm import plain
from tidewatch.llm import collocations, token_files, vector_codes
from tidewatch.llm.text import scratch, word_hash

WORDS = public.path("word_bpe_49k.json")


def phrase_rows():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ünd", "É", "x\x00y"]
    text = lambda: "".join(r.choice(vocabulary[: r.randint(3, 33)]) + r.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "?"]) for _ in range(r.randint(0, 60)))
    rows = [(text(), r.choice(["en", "en", "en", "de", None, "und", ""])) for _ in range(400)]
    return rows + [("new york city " * 50, "en"), ("Of THE of the of the", "en"), (None, "en"), (None, None), ("", "fr"), (". , !", "es")] + [("same words here again", "en")] * 40


@pytest.mark.parametrize("least", [3, 30])
def test_collocations(spark, least):
    rows = phrase_rows()
    docs = spark.createDataFrame([(i % 50 if i % 9 else None, t, lang, 1, "x") for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, k int, phrase string")
    got = collocations.collocations(docs.repartition(6), least=least).drop("place").collect()
    assert sorted(map(tuple, got)) == sorted(plain.collocations(rows, least))


def test_collocations_of_one_fingerprint(spark, monkeypatch):
    """All fingerprints alike: exact words still part the phrases."""
    monkeypatch.setattr(collocations._Batch, "fingerprints", lambda self, k: np.full(max(0, len(self.start) - k + 1), k - 1, np.uint64))
    rows = phrase_rows()

    def phrases(texts):
        import pyarrow as pa
        batch = pa.RecordBatch.from_pydict({"text": pa.array([t for t, _ in texts], pa.string()), "lang": pa.array([x for _, x in texts], pa.string()), "doc": pa.array([1] * len(texts), pa.int64())})
        found = {}
        for b in collocations._phrased(iter([batch]), type("Bits", (), {"value": np.full(4, 2**64 - 1, np.uint64)})):
            for row in b.to_pylist():
                found[row["lang"], row["phrase"]] = found.get((row["lang"], row["phrase"]), 0) + row["n"]
        return found

    want = {(x[0], x[2]): x[3] for x in plain.collocations(rows, 1, share=10**9, top=10**9)}
    got = phrases(rows)
    assert {k: got[k] for k in want} == want


def test_phrases_point_to_their_first_place(spark):
    docs = spark.createDataFrame([(7, "é, one two", "en"), (3, "x one two one two", "en"), (None, "zz", "en")], "doc_id long, text string, lang string")
    found = {r.phrase: (r.place.doc_id, r.place.at) for r in collocations.frequent(docs, 1)[0].collect()}
    assert found["one two"] == (3, 2) and found["é"] == (7, 0) and found["zz"] == (None, 0)


def test_long_texts_are_cut_into_batches(spark, monkeypatch):
    rows = [(" ".join(f"a{i % 7} b{i % 3}" for i in range(n)), "en") for n in (5, 4000, 9, 2000)]
    monkeypatch.setattr(collocations, "PIECE", 4000)
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    assert sorted(map(tuple, collocations.collocations(docs, 30).drop("place").collect())) == sorted(plain.collocations(rows, 30))


def test_no_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_hash_tells_patterned_words_apart():
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((one + two + one[:9] + one[:8] + "\0").encode(), np.uint8)
    start, end = np.array([0, 1024, 2048, 2057, 2057, 2066]), np.array([1024, 2048, 2057, 2065, 2066, 2066])
    for which in (0, 1):
        assert len(set(word_hash(data, start, end, which).tolist())) == 6
    again = np.concatenate([np.zeros(3, np.uint8), data])
    assert (word_hash(again, start + 3, end + 3) == word_hash(data, start, end)).all()


TEXTS = ["It's 3.5% - naïve ", "a<|endoftext|>b <|startoftext|>", "  x\n\n  y ", "ａ①ﬁ 日本 😀\0\t", "Ça_va__ Œuvre Ÿ ª º ÀÉ_x'S 'RE a'll 'tis ''s 's's", "µİ² x́ Σας", "'", "_", "",
         "x\r\ny\tz\x0bq\x1cw\x85e\xa0r", "×÷¿¡", "a" * 3000, " " * 40, "o'clock don't we'Re I'd'd", "1st 22nd", None, "# # id two #"]


def test_encoder_is_the_library_s():
    from tokenizers import Tokenizer

    stated = open(WORDS).read()
    known, found = Tokenizer.from_str(stated), token_files.Encoder(stated)
    r = random.Random(2)
    texts = [x or "" for x in TEXTS] + ["".join(r.choice("abst're'ml dvé×ŒñÑ 12.,#\n\t<|_") for _ in range(r.randint(0, 80))) for _ in range(3000)]
    for x, got in zip(texts, found.texts(texts)):
        assert got.tolist() == known.encode(x, add_special_tokens=False).ids, x
    assert token_files.splits_at_blanks(stated) and found.fast


def test_words_are_forgotten_in_generations(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT", 3)
    found = token_files.Encoder(open(WORDS).read())
    for texts in (["one two three four"], ["one five"], ["six seven eight nine ten 日本 国"], ["one 日本"]):
        assert [x.tolist() for x in found.texts(texts)] == [found.known.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip(seed):
    r = np.random.default_rng(seed)
    n = r.integers(0, 400, 30)
    ids = [r.zipf(1.5, k).astype(np.uint32) % 50 for k in n] + [np.full(500, 7, np.uint32), np.tile(np.arange(5, dtype=np.uint32), 90)]
    ends = np.cumsum([len(x) for x in ids])
    rules, lengths, symbols, cuts = token_files.compress(np.concatenate(ids), ends, 60, least=4)
    shard = token_files.Shard({"base": 60, "rules": rules.tobytes(), "lengths": lengths.tobytes(), "symbols": symbols.tobytes(), "n_symbols": np.diff(np.append(0, cuts))})
    assert len(symbols) < len(np.concatenate(ids)) and len(rules) and (shard.all() == np.concatenate(ids)).all()
    for j, want in enumerate(ids):
        assert shard.document(j).tolist() == want.tolist()
        for a, z in ((0, 1), (3, 40), (len(want) // 2, len(want)), (5, 5)):
            assert shard.span(j, a, z).tolist() == want[a:z].tolist()


def test_token_files(spark):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(WORDS)
    pairs = [(i * 5 - 9, t) for i, t in enumerate(TEXTS)] + [(None, "first one"), (1000, "b a"), (1000, "b a")] + [(2000 + i, t) for i, t in plain.rows() if i is not None and len(t or "") < 5000]
    docs = plain.frame(spark, pairs).repartition(5)
    path = scratch(spark, "test-tokens")
    token_files.write(docs, path, WORDS, 2, limit=300)
    stored = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [plain.order(r.doc_id) for r in stored] == sorted(plain.order(i) for i, _ in pairs)
    ids = {i: known.encode(t or "", add_special_tokens=False).ids + [2] for i, t in pairs if i is not None and i < 2000}
    start = 0
    for r in stored:
        assert (r.start, r.n_tokens) == (start, len(r.ids))
        start += r.n_tokens
        assert r.doc_id not in ids or r.ids == ids[r.doc_id]
    assert token_files.shards(spark, path).count() > 5
    some = token_files.read_documents(spark, path, [-9, 1, 1000])
    assert sorted((r.doc_id, r.ids) for r in some.collect()) == sorted([(-9, ids[-9]), (1, ids[1]), (1000, ids[1000]), (1000, ids[1000])])
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_files.digests(docs, WORDS, 2).collect()}
    assert got == {(r.doc_id, r.start): (r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in stored}


def test_no_token_files(spark):
    assert token_files.digests(plain.frame(spark, []), WORDS, 2).collect() == []


VECTORS = "vec_id long, embedding array<float>, label int, row int, p string"


def vector_rows(n=120, width=16, seed=1):
    r = random.Random(seed)
    f = lambda x: float(np.float32(x))
    rows = [(i * 3, [f(r.gauss(r.choice([-1, 0, 1]), 0.2)) for _ in range(width)], r.choice([None, 1, 2, 2, 2])) for i in range(n)]
    rows += [(10**6 + i, rows[4][1], 2) for i in range(40)] + [(1, None, 1), (2, [1.0] * (width - 1) + [float("nan")], 1), (4, [None] * width, 2), (5, [float("-inf")] * width, None)]
    return rows + [rows[3], rows[3]]


@pytest.mark.parametrize("rows", [vector_rows(), vector_rows(5, 8), vector_rows(30, 11), [(1, None, 1)], [(None, [0.5] * 8, None), (4, [0.25] * 3, 1)]], ids=["many", "few", "odd", "none", "short"])
def test_vector_codes(spark, rows):
    frame = spark.createDataFrame([(*x, 9, "q") for x in rows], VECTORS).repartition(4)
    got = sorted(map(tuple, vector_codes.digests(frame).collect()), key=repr)
    assert got == sorted(plain.vector_codes(rows), key=repr)


def test_no_vectors(spark):
    assert vector_codes.digests(spark.createDataFrame([], VECTORS)).collect() == []


def test_large_components_are_refused(spark):
    with pytest.raises(Exception, match="component is larger"):
        vector_codes.digests(spark.createDataFrame([(1, [1e9] * 8, 1, 1, "")], VECTORS)).collect()


def test_only_changing_members_move(spark):
    """A round writes what stays without a shuffle; what came is what changed its entry."""
    rows = spark.createDataFrame([(i, [float(i % 40), float(i % 7)] * 8, 1) for i in range(400)], "vec_id long, embedding array<float>, label int")
    members, _, books = vector_codes.train(rows, rounds=1)
    assert members.count() == 400 * 8 and members.select("row", "p").distinct().count() == 400 * 8
    state = vector_codes.Members(spark, "test-members")
    members.write.parquet(f"{state.path}/members/moved=false")
    members.limit(0).write.parquet(f"{state.path}/came")
    before = {(r.row, r.p): r.e for r in state.read().collect()}
    after = vector_codes._moved_on(spark, state, vector_codes.new_entries(state.read(), books), "test-next", 4)
    now = {(r.row, r.p): r.e for r in after.read().collect()}
    came = {(r.row, r.p) for r in spark.read.parquet(f"{after.path}/came").collect()}
    assert came == {k for k in now if now[k] != before[k]} and 0 < len(came) < len(now)
