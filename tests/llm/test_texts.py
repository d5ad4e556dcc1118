"""Quality, language, page text, token counts, pieces and the pipeline."""

import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import plain
from tidewatch.llm import html_main, language, line_dedup, pieces, quality, token_counts
from tidewatch.llm.text import materialised, mix

BPE, PIECES = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
ODD = ["a<|endoftext|>b <|endoftext|>", "  x\n\n  y ", "▁ ▁▁ x", "ａ①ﬁ 日本 😀\0\t", "a" * 3000, " " * 40, "It's 3.5% — naïve "]


@pytest.fixture(scope="module")
def pairs():
    return plain.rows() + [(1000 + i, t) for i, t in enumerate(ODD)]


@pytest.fixture(scope="module")
def docs(spark, pairs):
    return plain.frame(spark, pairs).repartition(3).cache()


def test_base_counts(docs, pairs):
    got = quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(i, *plain.base_counts(t)) for i, t in pairs], key=repr)


def test_quality_runs_without_python(docs):
    plan = quality.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_quality_follows_labels(spark, sf_dir):
    judged = quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("quality", "p")
    both = judged.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("not base_failed")
    right = both.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.93


def test_posterior_matches_plain_bayes(spark):
    model = {"good": 0.7} | {name: (0.6, 0.1) for name in quality.RULES}
    row = spark.createDataFrame([tuple([-1, 1] + [0] * (len(quality.RULES) - 2))], ", ".join(f"vote_{n} int" for n in quality.RULES))
    p = row.select(quality.posterior(model)).first()[0]
    assert p == pytest.approx(0.7 * 0.1 * 0.9 / (0.7 * 0.1 * 0.9 + 0.3 * 0.6 * 0.4))


def test_verdict_is_that_of_a_plain_maximisation(spark, sf_dir):
    """Posterior and verdict of every document against expectation-maximisation over single rows."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [f"vote_{n}" for n in quality.RULES]
    voted = quality.votes(quality.measures(texts)).select("doc_id", *names).collect()
    p = plain.weak_supervision([tuple(r)[1:] for r in voted], [good is not None for _, good in quality.RULES.values()], quality.ROUNDS)
    want = {r.doc_id: x for r, x in zip(voted, p)}
    judged = quality.judge(texts).collect()
    assert len({round(x, 6) for x in p}) > 5 and {r.doc_id: r.quality for r in judged} == pytest.approx(want, abs=1e-9)
    assert all(r.kept == (not r.base_failed and want[r.doc_id] >= 0.5) for r in judged)


def test_empty_quality(spark):
    assert quality.judge(plain.frame(spark, [])).count() == 0


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(found) > 20 and sum(r.lang == r.lang_pred for r in found) > 0.93 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_odd_cases(spark, docs):
    found = {r.doc_id: r for r in language.identify(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").otherwise("yy"))).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, r in found.items():
        if i is not None:
            assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", texts[i] or "")), i
    none = language.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language.identify(plain.frame(spark, [])).count() == 0


def test_language_is_that_of_plain_compression(spark, sf_dir):
    """Every prediction against fresh coders, one text and one language after another."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(-1, "²"), (-2, "½ Ⅷ"), (-3, "1 2 3"), (-4, ""), (-5, None), (-6, "x"), (-7, "the the the"), (-8, "日本語")]
    learned = language.fit(texts.filter(~language.held_out(F.col("doc_id"))))
    every = texts.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in language.predict(every, learned).collect()}
    assert got == {r.doc_id: plain.language(r.text, learned, language.CARRIER) for r in every.collect()}
    assert [got[i][0] for i in (-1, -2, -3, -4, -5)] == ["und"] * 5


def test_language_reads_no_label(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = language.fit(docs)
    a = language.predict(docs, learned).drop("doc_id")
    b = language.predict(docs.withColumn("lang", F.lit("zz")).withColumn("doc_id", F.col("doc_id") + 7), learned).drop("doc_id")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_token_counts(docs, pairs):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(BPE)
    want = [(i, len((t or "").encode()), n := len(known.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in pairs]
    assert sorted(map(tuple, token_counts.count_tokens(docs, BPE, public.PATTERN).collect()), key=repr) == sorted(want, key=repr)


def test_no_token_counts(spark):
    assert token_counts.count_tokens(plain.frame(spark, []), BPE, public.PATTERN).count() == 0


def test_pieces_without_dropout_are_the_library_s(pairs):
    import sentencepiece

    known, found = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.Agenda(pieces.load(PIECES), 1, 0.0)
    some = [(i, t or "") for i, t in pairs if "▁" not in (t or "")]
    for (_, t), got in zip(some, found.texts([t for _, t in some], [i for i, _ in some])):
        assert got.tolist() == known.encode(t)


def chunks_of(text, model):
    """Chunks of a text: a run of marks and what follows; a line end by itself, if no piece holds one."""
    text = "▁" + text.replace("▁", "\ud800").replace(" ", "▁")
    return re.findall("\n|▁+[^▁\n]*|[^▁\n]+" if model["lines"] else "▁+[^▁]*|[^▁]+", text)


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5])
def test_pieces_are_those_of_a_plain_agenda(pairs, dropout):
    """Every occurrence draws its own skips, by document, ordinal, place and rank."""
    model, seed = pieces.load(PIECES), 3
    found = pieces.Agenda(model, seed, dropout)
    r = random.Random(9)
    rows = [(i, (t or "")[:700]) for i, t in pairs] + [(5, "international"), (6, "international"), (None, "▁a ▁▁ b")]
    rows += [(7000 + k, "".join(r.choice("ab the \n▁  é日😀tion\0\t.ing") for _ in range(r.randint(0, 90)))) for k in range(60)] + [(-1, "x" * 90), (-2, "internationally" * 9)]
    for (i, t), got in zip(rows, found.texts([t for _, t in rows], [i for i, _ in rows])):
        base = pieces._fold((seed * 0x9E3779B97F4A7C15 ^ ((i or 0) & (1 << 64) - 1)) & (1 << 64) - 1)
        want = []
        for k, chunk in enumerate(chunks_of(t, model) if t else []):
            key = int(mix(np.array([base + k & (1 << 64) - 1], np.uint64))[0])
            drop = lambda rank, place, key=key: dropout and found.flags[((rank << 32 | place) ^ key) * 0x9E3779B97F4A7C15 >> 40 & 0xFFFF]
            for piece in plain.agenda(chunk, model["rank"], drop):
                whole = model["ids"].get(piece)
                want += [whole] if whole is not None else [model["byte"] + b for c in piece for b in ("▁" if c == "\ud800" else c).encode()]
        assert got.tolist() == want, t


def test_pieces_drop_merges_of_each_occurrence():
    found = pieces.Agenda(pieces.load(PIECES), 3, 0.3)
    kinds = {tuple(x.tolist()) for x in found.texts(["international"] * 400, list(range(400)))}
    assert len(kinds) > 20
    ids = found.texts(["international " * 40], [1])[0].tolist()
    words = "".join(f"{i} " for i in ids).split(str(found.model["ids"]["▁"]))
    assert len(set(words)) > 5


def test_pieces_of_many_texts_equal_those_of_each(monkeypatch):
    found = pieces.Agenda(pieces.load(PIECES), 3, 0.2)
    texts = ["one two three", "", "four " * 50, "x" * 70, "\n", "five"]
    whole = [x.tolist() for x in found.texts(texts, list(range(6)))]
    monkeypatch.setattr(pieces, "BATCH_CHARS", 1)
    assert whole == [x.tolist() for x in found.texts(texts, list(range(6)))] and whole[1] == []


def test_no_pieces(spark):
    nothing = plain.frame(spark, [])
    assert pieces.digest(nothing, PIECES).count() == pieces.decode(pieces.encode(nothing, PIECES), PIECES).count() == 0
    assert token_counts.count_tokens(nothing, BPE, public.PATTERN).count() == 0


def test_pieces_round_trip(spark, docs, pairs):
    coded = pieces.encode(docs, PIECES, seed=5, dropout=0.3).cache()
    back = sorted(((r.doc_id, r.text) for r in pieces.decode(coded, PIECES).collect()), key=repr)
    assert back == sorted([(i, t or "") for i, t in pairs], key=repr)
    assert all(r.n_pieces == len(r.pieces) for r in coded.collect())
    again = {r.doc_id: r.pieces for r in pieces.encode(docs.repartition(7), PIECES, seed=5, dropout=0.3).collect()}
    other = {r.doc_id: r.pieces for r in pieces.encode(docs, PIECES, seed=6, dropout=0.3).collect()}
    mine = {r.doc_id: r.pieces for r in coded.collect()}
    assert again.keys() == mine.keys() and all(again[i] == mine[i] for i in mine if i is not None)
    assert sum(other[i] != mine[i] for i in mine) > 30
    assert all(r.lossless for r in pieces.digest(docs, PIECES).collect())


PAGES = [
    ("<article><header><h1>T&amp;C</h1></header><nav>no</nav><p>One <b>two</b>\n three<p>Four<br>five<aside>no</aside></article><p>out", "T&C\nOne two three\nFour\nfive"),
    ("<body><main>a<script>var x='</main>'</script><style>p{}</style> b<form><p>no</form></main><footer>f</footer>", "a b"),
    ("<article><p>x &lt; y &#8217; &nbsp;z</p><div class='comments'><article>no</article></div></article>", "x < y ’ z"),
    ("<article><div id=cookie-notice>no</div><ul><li>1<li>2</ul><p hidden>no</p></article>", "1\n2"),
    ("<article><p>cut off <b>here <a href=\"x", "cut off here"),
    ("<article><p>sh</p><p>same</p><p>same</p></article>", "sh\nsame\nsame"),
    ("<article><p data-id='comment-3'>a</p><p title='see role=alert'>b</p><p title=\"the hidden truth\">c</p><p class='not-hidden md:block'>d</p>"
     "<div class='share-price-table'>e</div><div class='post-content'>f</div></article>", "a\nb\nc\nd\ne\nf"),
    ("<article><p>a</p><div class='site-footer top'>no</div><div id='comment-3'>no</div><p class='cookie-notice'>no</p><p style='color:red; display : none'>no</p>"
     "<p aria-hidden=true>no</p><p HIDDEN>no</p><div role=navigation>no</div><p aria-hidden='false'>b</p></article>", "a\nb"),
    ("", ""), (None, ""),
]


def test_main_text(spark):
    pages = spark.createDataFrame([(i, f"http://a.b/{i}", h, 1, "x") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, page int, host string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_main.main_text(pages).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)}


def test_open_pages_lose_what_their_host_repeats(spark):
    repeated, r = "subscribe to our great weekly letter now", random.Random(1)
    own = [" ".join(f"w{r.randrange(10**6)}" for _ in range(30)) for _ in range(9)]
    rows = [(i, f"https://Host.example/{i}", f"<div>{repeated}</div><p>{t}</p><div>all rights</div>") for i, t in enumerate(own)]
    rows += [(50, "https://other.example/", f"<div>{repeated}</div><p>{own[0]}</p>"), (51, None, "plain")]
    got = {x.page_id: x.text for x in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**dict(enumerate(own)), 50: f"{repeated}\n{own[0]}", 51: "plain"}


def test_tags_in_scripts_and_comments_do_not_mark_a_page(spark):
    menu = "<div>home news about contact imprint more</div>"
    rows = [(i, f"http://a.b/{i}", f"<!--<main>-->{menu}<script>'<article>'</script><p>own text {i} of this page only {i} here</p>") for i in range(5)]
    got = {x.page_id: x.text for x in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"own text {i} of this page only {i} here" for i in range(5)}


def test_copies_of_an_open_article_stay(spark):
    r = random.Random(4)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(40))
    whole = text()
    rows = [(i, f"http://a.b/{i}", f"<div>menu of the site with links</div><p>{whole if i < 3 else text()}</p>") for i in range(12)]
    got = {x.page_id: x.text for x in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == whole for i in range(3)) and all("menu" not in t and len(t.split(" ")) == 40 for t in got.values())


def plain_pages(rows, window=6, least_pages=3, least_share=0.1):
    """Open pages (page_id, host, block texts) without what their host repeats, window by window."""
    hosts, out = {}, {}
    for _, host, parts in rows:
        hosts.setdefault(host, set()).add(tuple(parts))
    for i, host, parts in rows:
        grams = lambda p: [tuple(p.split(" ")[j:j + window]) for j in range(max(1, len(p.split(" ")) - window + 1))]
        on = lambda g: sum(any(g in grams(x) for x in page) for page in hosts[host])
        lines = []
        for p in parts:
            w = p.split(" ")
            gone = set()
            for j, g in enumerate(grams(p)):
                if on(g) >= max(least_pages, least_share * len(hosts[host])):
                    gone.update(range(j, j + len(g)))
            lines.append(" ".join(x for j, x in enumerate(w) if j not in gone))
        out[i] = "\n".join(x for x in lines if x)
    return out


def test_open_pages_against_plain_windows(spark):
    r = random.Random(12)
    stock = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 14))) for _ in range(14)]
    rows = [(i, r.choice(["x.y", "x.y", "z"]), [r.choice(stock) if r.random() < 0.6 else " ".join(f"u{r.randrange(9999)}" for _ in range(9)) for _ in range(r.randint(1, 5))]) for i in range(40)]
    frame = spark.createDataFrame([(i, f"http://{h}/{i}", "".join(f"<p>{p}</p>" for p in parts)) for i, h, parts in rows], "page_id long, url string, html string")
    assert {x.page_id: x.text for x in html_main.main_text(frame.repartition(4)).collect()} == plain_pages(rows)


def test_marked_pages_go_through_their_host_too(spark):
    """Chrome of marked pages tells an unnamed menu elsewhere; a repeated teaser in an article element is no article; articles stay whole."""
    menu, teaser = "home news about contact imprint more", "subscribe to our great weekly letter now"
    rows = [(i, f"http://a.b/{i}", f"<nav>{menu}</nav><aside>{teaser}</aside><article><p>own text {i} of page</p><p>{menu}</p></article>") for i in range(4)]
    rows += [(4, "http://a.b/4", f"<div>{menu}</div><p>the only page without a mark</p>"),
             (5, "http://a.b/5", f"<div>{menu}</div><article>{teaser}</article><p>unmarked text beside a teaser</p>"),
             (6, "http://c.d/6", f"<div>{menu}</div><article>{teaser}</article><p>out</p>")]
    got = {x.page_id: x.text for x in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"own text {i} of page\n{menu}" for i in range(4)}, 4: "the only page without a mark", 5: "unmarked text beside a teaser", 6: teaser}


def plain_mixed_pages(rows, window=6, least_pages=3, least_share=0.1):
    """Pages (page_id, host, marked, open, chrome texts) by all windows of their host's chrome and open texts, then the check by markup."""
    grams = lambda p: [tuple(p.split(" ")[j:j + window]) for j in range(max(1, len(p.split(" ")) - window + 1))]
    outside, unmarked = {}, {}
    for _, host, marked, other, around in rows:
        page = (tuple(marked), tuple(other))
        outside.setdefault(host, {}).setdefault(page, set()).update(g for p in other + around for g in grams(p))
        if other and not marked:
            unmarked.setdefault(host, {})[page] = {g for p in other for g in grams(p)}
    enough = lambda g, pages: sum(g in x for x in pages.values()) >= max(least_pages, least_share * len(pages))

    def left(host, parts):
        lines = []
        for p in parts:
            gone = {k for j, g in enumerate(grams(p)) if enough(g, outside[host]) or enough(g, unmarked.get(host, {})) for k in range(j, j + len(g))}
            lines.append(" ".join(w for k, w in enumerate(p.split(" ")) if k not in gone))
        return "\n".join(x for x in lines if x)

    return {i: "\n".join(marked) if marked and (left(host, marked) or not left(host, other)) else left(host, other) for i, host, marked, other, _ in rows}


def test_mixed_pages_against_plain_windows(spark):
    r = random.Random(7)
    stock = [" ".join(r.choice("abcdefghijkl") for _ in range(r.randint(1, 14))) for _ in range(40)]
    some = lambda most, own: [r.choice(stock) if r.random() > own else " ".join(f"u{r.randrange(9999)}" for _ in range(9)) for _ in range(r.randint(0, most))]
    rows = [(i, r.choice(["x.y", "x.y", "z", "w"]), some(2, .3) if r.random() < .6 else [], some(4, .4), some(3, .1)) for i in range(90)]
    tags = lambda start, parts, end: "".join(start + p + end for p in parts)
    html = lambda m, o, c: tags("<article>", m, "</article>") + tags("<p>", o, "</p>") + tags("<nav>", c, "</nav>")
    frame = spark.createDataFrame([(i, f"http://{h}/{i}", html(*parts)) for i, h, *parts in rows], "page_id long, url string, html string")
    plain = plain_mixed_pages(rows)
    assert {x.page_id: x.text for x in html_main.main_text(frame.repartition(4)).collect()} == plain
    assert any(m and plain[i] != "\n".join(m) for i, _, m, _, _ in rows) and any(not m and plain[i] != "\n".join(o) for i, _, m, o, _ in rows)


def test_pages_in_small_runs(monkeypatch):
    """Pages and blocks that fall into several runs give what one run gives."""
    r = random.Random(3)
    stock = [" ".join(r.choice("abcdef") for _ in range(r.randint(1, 9))) for _ in range(9)]
    pages = ["".join(f"<{t}>{r.choice(stock)}</{t}>" for t in r.choices(["p", "article", "nav", "p"], k=r.randint(0, 6))) for _ in range(30)]
    columns = [pa.array(range(30), pa.int64()), pa.array(["u"] * 30), pa.array([x or None for x in pages]), pa.array([1] * 30, pa.int64())]
    batch = pa.RecordBatch.from_arrays(columns, ["page_id", "url", "html", "host"])
    got = []
    for size in (1 << 21, 25, 1):
        monkeypatch.setattr(html_main, "PIECE_BYTES", size)
        parsed = pa.Table.from_batches(html_main._parsed([batch], 6)).combine_chunks()
        keys = sorted({w["key"] for page in parsed["windows"].to_pylist()[::3] for w in page})
        told = parsed.select(["page_id", "url", "marked", "open"]).append_column("keys", pa.array([keys if i % 4 else [] for i in range(30)], pa.list_(pa.int64())))
        got.append((parsed.to_pylist(), [x for b in html_main._unique(told.to_batches(), 6) for x in b.to_pylist()]))
    assert got[0] == got[1] == got[2] and len({x["text"] for x in got[0][1]}) > 5


def test_empty_pages(spark):
    assert html_main.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, states = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        states.append(materialised(stage(spark, states[-1], sf_dir), name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert states[-1].columns == columns
    known = [{r.doc_id: r.text for r in s.collect()} for s in states[:-1]]
    assert {r.doc_id for r in language.predict(docs, language.fit(docs.filter(~language.held_out(F.col("doc_id"))))).filter("not rejected").collect()} == set(known[1])
    assert known[2] == {i: t for i, _, _, t in plain.lines(sorted(known[1].items()))}
    group = plain.near_groups(sorted(known[2].items()))
    assert set(known[3]) == {i for i in group if group[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(known[4]) == {i for i, *_, hit in plain.leaks(known[3].items(), items) if not hit}
    assert {r.doc_id: r.text for r in pieces.decode(states[-1], PIECES).collect()} == known[4]


def test_run_gives_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "n_pieces", "pieces"]
    assert line_dedup.remove(plain.frame(spark, [])).count() == 0
