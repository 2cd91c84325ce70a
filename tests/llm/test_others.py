import duckdb
import numpy as np
import pytest
from compare import rows as table
from compare import sql_rows
from compare import SF

from graphloom.llm import ann_search, decontamination, html_extraction, language_id, mixing, quality_classifier, token_counts
from graphloom.llm import queries as llm


def test_token_counts(docs, rows, no_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.vocabulary())
    odd = [(200, "a<|endoftext|>b <|startoftext|> don't 'll"), (201, "ﬁ Ǆ İ ς é ́a"), (202, "x" * 70000), (203, "a\r\nb\tc  d")]
    more = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(odd, "doc_id long, text string"))
    got = sorted(tuple(r) for r in token_counts.count_tokens(more, token_counts.vocabulary()).collect())
    want = sorted((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False))) for i, x, *_ in [*rows, *odd])
    assert got == want
    assert token_counts.count_tokens(no_docs, token_counts.vocabulary()).count() == 0


def test_decontamination(spark, docs, rows, no_docs):
    r = {i: t for i, t, *_ in rows}
    items = [(1, " ".join(r[7].split()[12:40])), (2, "one"), (3, None), (4, ""), (5, "no such words at all here"), (6, r[103][1000:1300].split(" ", 1)[1]), (1, " ".join(r[7].split()[12:40]))]
    table_ = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for j, t in items:
        q = decontamination.shingles(t)
        for i, x in r.items():
            shared = len(q & decontamination.shingles(x))
            if q and 10 * shared >= 8 * len(q):
                want.add((i, j, shared, len(q), shared / len(q)))
    for item_bytes in (decontamination.ITEM_BYTES, 200):
        assert {tuple(x) for x in decontamination.find_leaks(docs, table_, item_bytes=item_bytes).collect()} == want
    assert {i for i, *_ in want} >= {7, 105, 106, 103}
    for item_bytes in (decontamination.ITEM_BYTES, 200):
        kept = decontamination.without_leaks(docs, table_, item_bytes=item_bytes)
        assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == set(r) - {i for i, *_ in want}
    # short items inside longer documents, by broadcast and by join
    both = [{tuple(x) for x in decontamination.find_leaks(docs, table_, item_bytes=n, short_inside=True).collect()} for n in (decontamination.ITEM_BYTES, 200)]
    assert both[0] == both[1] >= want and {i for i, j, *_ in both[0] if j == 2} == {i for i, t in r.items() if "one" in (t or "").lower().split()}
    assert decontamination.find_leaks(docs, table_.limit(0)).count() == 0 and decontamination.find_leaks(no_docs, table_).count() == 0


def test_mixing(spark, docs, rows, no_docs):
    con = duckdb.connect()
    frame = docs.select("doc_id", "text", "lang", "source").toPandas()  # noqa: F841  read by DuckDB
    con.sql("CREATE TABLE documents AS SELECT * FROM frame")
    assert table(mixing.mix(docs, mixing.domain_of_source(docs.source), mixing.WEIGHTS)) == sql_rows(con, mixing.ORACLE_SQL)
    assert mixing.mix(no_docs, mixing.domain_of_source(no_docs.source), mixing.WEIGHTS).count() == 0


def test_mixing_gives_shortages_to_siblings_first(spark):
    rows = [(i, " ".join(["w"] * 10), "en", "a1") for i in range(2)] + [(10 + i, " ".join(["w"] * 10), "en", "b1") for i in range(20)] + [(40 + i, " ".join(["w"] * 10), "de", "a2") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(df, df.source.substr(2, 1), {}, share=0.5, max_epochs=1).groupBy("domain", "source").sum("n_tokens").collect()
    # budget 210: 105 for each domain; a1 has but 20, so its sibling b1 takes 85 (8 documents fit)
    assert {(r[0], r[1], r[2]) for r in got} == {("1", "a1", 20), ("1", "b1", 80), ("2", "a2", 100)}


def test_mixing_epochs(spark):
    df = spark.createDataFrame([(1, "a b c d", "en", "s"), (2, "a b c d", "en", "s")], "doc_id long, text string, lang string, source string")
    got = mixing.mix(df, df.source, {}, share=2.5, max_epochs=4)
    assert sorted(r.n_copies for r in got.collect()) == [2, 3]


def test_language_id(spark, no_docs):
    df = llm.queries()["op3_language_id"](spark, SF)
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = df.join(lang, "doc_id").where("held_out").collect()
    assert len(held) > 20 and np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    model = language_id.Model(np.stack([language_id.features(np.frombuffer(t, np.uint8)) for t in (b"the cat sat", b"le chat noir", b"el gato", b"the dog ran")]), np.array(["en", "fr", "es", "en"]))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the cat"), (None, "le chat"), (4, "the cat"), (5, "é")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 1.0) and got[4][0] == "en" and got[None][0] == "fr" and 0 <= got[5][1] <= 1
    none = language_id.fit(no_docs)
    assert language_id.predict(odd, none).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(no_docs, model).count() == 0


def test_quality(spark, no_docs):
    df = llm.queries()["op9_quality"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = df.join(labels, "doc_id").collect()
    assert df.count() == 200 and np.mean([r.predicted == r.quality for r in got]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_quality_of_odd_rows(spark, no_docs, odd_docs):
    r = np.random.default_rng(0)
    good = [bytes(r.integers(97, 123, 300, dtype=np.uint8)) for _ in range(60)]
    bad = [b"!! " * 100 for _ in range(60)]
    net = quality_classifier.Network().train(good + bad, np.array([1] * 60 + [0] * 60), steps=60)
    df = spark.createDataFrame([(1, None), (2, ""), (3, good[0].decode() * 400), (4, "!! " * 9000), (None, "x")], "doc_id long, text string")
    got = {x.doc_id: x.score for x in quality_classifier.score(df, net).collect()}
    assert got[3] > 0.7 and got[4] < 0.3 and got[1] == got[2]
    # junk anywhere in a long text counts: chunks cover it whole
    start, n = quality_classifier.chunk_starts(np.array([0, 1, 512, 513, 5000]))
    assert n.tolist() == [1, 1, 1, 2, 11] and start[-1] == 5000 - 512
    assert quality_classifier.score(no_docs, net).count() == 0
    nothing = quality_classifier.fit(odd_docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {x.score for x in quality_classifier.score(odd_docs, nothing).collect()} == {0.5}


def test_groups_of_lists():
    r = np.random.default_rng(0)
    sizes = np.array([10, 20, 500, 0, 30, 90, 5])
    first, count = ann_search.groups_of_lists(r.normal(size=(7, 4)), sizes, 100)
    assert count.tolist() == [1, 1, 5, 1, 1, 1, 1]
    own = set(range(first[2], first[2] + 5))
    held = {}
    for i in (0, 1, 3, 4, 5, 6):
        assert first[i] not in own
        held[first[i]] = held.get(first[i], 0) + sizes[i]
    assert all(n <= 100 for n in held.values()) and own | set(held) == set(range(max(own | set(held)) + 1))


@pytest.mark.parametrize("scale, limits", [(False, {}), (True, {}), (True, {"part": 100, "asks": 20})])
def test_nearest_neighbours(spark, scale, limits):
    r = np.random.default_rng(3)
    x = r.normal(size=(1500, 24)) + 2 * r.normal(size=(12, 24))[r.integers(0, 12, 1500)]
    x *= r.uniform(0.2, 3, (1500, 1)) if scale else 1 / np.linalg.norm(x, axis=1, keepdims=True)
    x[700:1100] = x[700]  # a group of copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 24), (2020, [float("nan")] * 24), (2040, [1.0, None] * 12), (2060, [1.0, 2.0]), (None, x[0].tolist())]
    # other columns with names that the search uses itself
    df = spark.createDataFrame([(*x, 1, 2, "a", 3.0, [1]) for x in rows], "vec_id long, embedding array<double>, list int, part int, asks string, bound double, v array<int>")
    got = ann_search.search(df, df.vec_id % 20 == 0, **limits).orderBy("query_id", "rank").toPandas()
    assert sorted(got.query_id.unique()) == list(range(0, 1500, 20)) and (got.groupby("query_id").size() == 20).all()
    hits = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        assert np.allclose(g.score, s[g.vec_id]) and g["rank"].tolist() == list(range(1, 21)) and q not in set(g.vec_id)
        assert list(zip(-g.score, g.vec_id, strict=True)) == sorted(zip(-g.score, g.vec_id, strict=True))
        hits += (s[g.vec_id] >= np.sort(s)[-20] - 1e-9).sum()
    assert hits / len(got) >= 0.9
    assert ann_search.search(df.limit(0), df.vec_id % 20 == 0).count() == 0
    few = ann_search.search(df.where("vec_id in (0, 1, 2)"), df.vec_id % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def test_recall_on_the_table(spark):
    got = llm.queries()["op7_ann_search"](spark, SF).toPandas()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    hit = []
    for q, g in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hit.append(len(set(ids[np.argsort(-s)[:20]]) & set(g.vec_id)) / 20)
    assert np.mean(hit) >= 0.9


def test_html_on_unseen_pages():
    model, wrong, total = html_extraction.trained(), 0, 0
    for h in html_extraction.labelled_pages(40, seed=77):
        page = html_extraction.Page(h)
        labels = html_extraction.labels_of(page)
        content, _ = model.marginals(page, page.features())
        for node, _, _ in page.runs:
            total += 1
            wrong += (content[node] >= 0.5) != bool(labels[node])
    assert wrong / total < 0.02


def test_marginals_are_those_of_all_labellings():
    from itertools import product

    model = html_extraction.trained()
    page = html_extraction.Page("<body><nav><a href=x>a</a></nav><article><h1>T</h1><p>Some words here.<p>More.</article><footer>f</footer>")
    f = page.features()
    content, _ = model.marginals(page, f)
    own = [np.exp(np.clip(sum(model.weights.get(x, 0) for x in y), -30, 30)) for y in f]
    n, total, each = len(f), 0.0, np.zeros(len(f))
    for y in product((0, 1), repeat=n):
        p = np.prod([own[i] if y[i] else 1.0 for i in range(n)]) * np.prod([np.exp(model.pairs[html_extraction._kind(page.tag[i]), y[page.parent[i]], y[i]]) for i in range(1, n)])
        total += p
        each += p * np.array(y)
    assert np.allclose(each / total, content)


def test_html_text(spark):
    html = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body><nav><ul><li><a href="/a">no</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy now.</div>
    <article><h1>A &amp; B</h1><p>First&nbsp;line\n  with <b>bold &lt;3<br>text.<p>Second &#233;t&eacute; <a href=x title="a>b">link</a>.</p><ul><li>One thing here</li><li>Two things here</li></ul></article>
    <section id="comments"><div class="comment"><p>no, a reader says.</p></div></section><form><label>no</label><input><button>no</button></form><footer>&copy; no</footer></body></html>"""
    rows = [(1, "u", html), (2, None, None), (3, "u", ""), (4, "u", "<article><p>" + "word " * 50000 + "</article>"), (1, "u", html), (None, "u", "<<<>"), (5, "u", "<p <a <b 'x")]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), html_extraction.trained()).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 7 and by[1].text == "A & B\n\nFirst line with bold <3 text.\n\nSecond été link.\n\nOne thing here\n\nTwo things here"
    assert by[2].text == by[3].text == "" and by[4].n_chars == 50000 * 5 - 1 and by[1].n_chars == len(by[1].text)


def test_registered_queries_and_their_sql(spark, duck):
    names = list(llm.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    for name in ("op4_decontamination", "op5_jaccard_join", "op6_mixing"):
        assert table(llm.queries()[name](spark, SF)) == sql_rows(duck, llm.oracle_sql()[name])


@pytest.mark.parametrize(
    "inside",
    [
        '<p>Before it.</p><svg class="icon" viewBox="0 0 1 1"/><p>After it.</p>',
        "<p>Before it.</p><svg/><p>After it.</p><svg><path d=x /></svg>",
        "<p>Before it.</p><svg><style/><script /><path/></svg><p>After it.</p><script>no</script>",
        "<p>Before it.</p><svg><title>no</title><style>no</style></svg><p>After it.</p>",
        '<p>Before it.</p><iframe src="x"/><p>After it.</p>',
        "<p>Before it.</p><iframe src=x/>no</iframe><p>After it.</p>",
        "<noscript><p>Before it.</p></noscript><p>After it.</p>",
        "<p>Before <math><mi>it</mi></math>.</p><p>After it.</p>",
        "<p>Before <svg><text><![CDATA[it.]]></text></svg></p><video><p>After it.</p></video><canvas/>",
        "<object data=x><p>Before it.</p></object><audio/><p>After it.</p><template>no</template>",
    ],
)
def test_html_keeps_what_is_beside_and_inside_other_elements(inside):
    page = f"<html><body><article><h1>A title</h1>{inside}<p>And the end.</p></article></body></html>"
    assert html_extraction.trained().extract(page) == "A title\n\nBefore it.\n\nAfter it.\n\nAnd the end."


def test_short_items_inside_long_documents(spark, tmp_path):
    import corpus_pipeline

    filler = "w1 w2 w3 w4 w5 w6 w7 w8 w9 "
    docs = [(1, filler + "Red green blue sky " + filler), (2, "red\ngreen " + filler), (3, filler + "sky"), (4, "red"), (5, "red green"), (6, "green blue"), (7, filler), (8, ""), (9, None), (10, filler + "red"), (11, "green " + filler), (12, "red green blue sky today")]
    items = [(1, "RED"), (2, "red green"), (3, "green blue sky"), (4, "red  green blue sky"), (5, "w9 red green blue sky w1"), (6, "red blue"), (7, "")]
    want = set()
    for d, x in docs:
        for i, t in items:
            a, b = (x or "").lower().split(), t.lower().split()
            shingle = {tuple(b[j : j + min(5, len(b))]) for j in range(max(1, len(b) - 4))} if b else set()
            shared = sum(any(tuple(a[j : j + len(s)]) == s for j in range(len(a))) for s in shingle)
            if shingle and shared >= 0.8 * len(shingle):
                want.add((d, i, shared, len(shingle), shared / len(shingle)))
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = decontamination.op4_decontamination(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == want and {(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (2, 2), (12, 4)} <= {x[:2] for x in want}
    kept = corpus_pipeline.benchmark_leaks(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {x[0] for x in want} == {3, 6, 7, 8, 9, 11}
