"""Parsing of markup, crawl order, spans, chunks and the client, on small cases."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weblode.client import WebClient
from weblode.functions import chunk, classify, patterns, score, text
from weblode.operators import crawl, documents, labels, links, prompt
from weblode.plans import registry
from weblode.sources import html, pages, sinks
from weblode.streaming import pages as stream

KEYWORDS = ["alpha", "beta"]


def parse(markup, *want):
    return html.parse(markup, want or ("title", "meta", "article", "article_text", "main_text", "clean_text"))


@pytest.mark.parametrize(
    ("markup", "main"),
    [
        ("<body>x<article>a <b>b</b> c</article></body>", "abc"),
        ("<main>m</main><div class='content'>c</div>", "m"),
        ("<div class='my-Article'>k</div>", "k"),
        ("<div class='Page content'>k</div>", "k"),
        ("<p>no body", "no body"),
        ("", ""),
        ("<article>a<script>var x='</p>'</script><style>p{}</style><!-- c --></article>", "a"),
        ("<article>&amp;&copy;&middot;</article>", "&©·"),
        ("<article><p>one<p>two<b>x</article> after", "onetwox"),
        ("</p><article>a</b>b<br>c</article>", "abc"),
    ],
)
def test_main_text(markup, main):
    assert parse(markup)["main_text"] == main


@pytest.mark.parametrize(("markup", "text"), [("a&amp;&amp", "a&&amp"), ("&copyx &notit; &am", "&copyx &notit; &am"), ("&#38; &#x26; &#38", "& & &#38"), ("&&lt;&", "&<&"), ("\ufdd0&copy", "\ufdd0&copy")])
def test_references_end_with_a_semicolon(markup, text):
    out = parse(f"<title>{markup}</title><article>{markup}</article>", "title", "article_text", "main_text", "article")
    assert out == dict.fromkeys(out, text)


def test_references_in_attributes_and_scripts():
    (a,) = html.parse("<a href='/x?a=1&copy&amp;b&lt'>&amp</a>", ("anchors",))["anchors"]
    assert a["href"] == "/x?a=1&copy&b&lt" and a["text"] == "&amp"
    assert html.parse("<script>a && b &amp; c</script>", ("nodes",))["nodes"][1]["text"] == "a && b &amp; c"


def test_title_meta_and_boilerplate():
    out = parse("<title></title><h1> H </h1><meta NAME='Author' content='A'><meta name=author content=B><meta name=date><meta property=og:x content=y>")
    assert out["title"] == "H" and dict(out["meta"]) == {"author": "B", "date": ""}
    assert parse("<nav>n</nav><div role=main>d<footer>f</footer></div>")["clean_text"] == "d"
    assert parse("<nav>n</nav>x<header>h</header>y")["clean_text"] == "xy"


@pytest.mark.parametrize(("attrs", "nav"), [("class='x MainNav'", True), ("id=sidebar1", True), ("role=navigation", True), ("class=text", False), ("", False)])
def test_navigation(attrs, nav):
    (a,) = html.parse(f"<div {attrs}><a href='/x'>t</a></div>", ("anchors",))["anchors"]
    assert a["navigation"] is nav and a["text"] == "t" and a["context"] == "t"


def test_nodes_and_tables():
    nodes = html.parse("<div id=a><p></p><p>x<i>y</i></p></div>", ("nodes",))["nodes"]
    assert [(n["tag"], n["parent_id"], n["depth"], n["text"]) for n in nodes] == [("[document]", -1, 0, "xy"), ("div", 0, 1, "xy"), ("p", 1, 2, "xy"), ("i", 2, 3, "y")]
    (t,) = html.parse("<table><tr><th>h</th></tr><tr><td> </td></tr><tr><td>1</td><td>2</td></tr></table>", ("tables",))["tables"]
    assert t["headers"] == ["h"] and t["rows"] == [["h"], ["1", "2"]]


def naive(node):
    return "".join(c.strip() if isinstance(c, str) else naive(c) if c.tag not in html.RAW else "" for c in node.children)


@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<br>", " x ", "y", "&amp;", "<script>", "</script>", "<div>", "</div>", "\n"]), max_size=30))
@settings(max_examples=80, deadline=None)
def test_slices_are_the_text_of_elements(parts):
    page = html.Page("".join(parts))
    for n in page.root.walk():
        if n.tag not in html.RAW:
            assert page.text(n) == naive(n)


def test_scores_on_their_thresholds(spark):
    rows = [("alpha",), ("alpha beta",), ("",), ("function",), (" ".join(["w"] * 50),), (" ".join(["w"] * 51),), ("SELECT x",)]
    df = spark.createDataFrame(rows, "t string").coalesce(1)
    t = F.col("t")
    assert [r[0] for r in df.select(score.quick(t, KEYWORDS)).collect()] == [0.4, 0.7, 0.0, 0.2 + 0.1, 0.0, 0.1, 0.2 + 0.1]
    got = [r[0] for r in df.select(score.content(t, KEYWORDS)).collect()]
    assert got == [2 / 3 + 0.1, 1.0, 0.0, 0.1, 0.0, 0.1, 0.2 + 0.1]
    tokens = spark.createDataFrame([(" ".join(["w"] * n),) for n in (147, 148)], "t string")
    assert [r[0] > 0.3 for r in tokens.select(score.semantic(t, [], {}, lambda c: text.word_count(c) + 2)).collect()] == [False, True]


def test_chunks_lose_nothing(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["Ab ", "c; d", "}", "x. Y", "\nZ", "e.g. x ", "É.", "? Q ", "\n\n"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for r in df.select("t", chunk.sentences(F.col("t")).alias("s"), chunk.semantic_chunks(F.col("t"), 6).alias("c")).collect():
        bare = "".join(r["t"].split())
        assert "".join("".join(r["s"]).split()) == bare and "".join("".join(r["c"]).split()) == bare
        assert all(0 < len(c.split()) <= 6 for c in r["c"])


def test_labels_of_chunks(spark):
    cases = {"function f(x)": "code_function", "CLASS A": "code_class", "import a from b": "code_import", "const a =": "code_variable", "<b>": "code_markup", "select a from b": "code_sql", "select a\nb from c": "text", "the api": "technical_content", "for example": "example", "plain": "text"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    for r in df.select("t", "want", classify.chunk_type(F.col("t")).alias("got")).collect():
        assert r["got"] == r["want"], r["t"]
    lang = spark.createDataFrame([("x", ["language-objective-c"]), ("import React", []), ("let a = 1", ["plain"]), ("?", [])], "t string, c array<string>")
    assert [r[0] for r in lang.select(classify.code_language(F.col("t"), F.col("c"))).collect()] == ["objective", "python", "javascript", "unknown"]


def test_patterns(spark):
    df = spark.createDataFrame([('f(a) { x } @dec "k": 12px http://a.b snake_case CamelCase CONST_X my api call',)], "t string")
    r = df.select(patterns.syntax(F.col("t")).alias("s"), patterns.structured(F.col("t")).alias("d"), patterns.technical_terms(F.col("t")).alias("t"), patterns.domains(F.col("t")).alias("o")).first()
    assert r["s"] == ["decorator_annotation", "function_definition"]
    assert r["d"] == ["json_like", "measurement", "nested_structure", "url"]
    assert {"snake_case", "CamelCase", "CONST_X", "my api call"} <= set(r["t"]) and r["o"] == ["web_api"]


def test_votes_and_spans(spark):
    rows = [("a", "b", "c", "a"), ("a", "b", "b", "b"), ("a", "a", "b", "a"), ("a", "b", "a", "a")]
    got = spark.createDataFrame(rows, "a string, b string, c string, want string").select(labels.vote(F.col("a"), F.col("b"), F.col("c")) == F.col("want")).collect()
    assert all(r[0] for r in got)
    tags = ["B-X", "I-X", "O", "I-X", "B-X", "B-Y", "I-Z"]
    df = spark.createDataFrame([(1, k, f"t{k}", t) for k, t in enumerate(tags)], "doc_id long, pos int, token string, label string")
    assert sorted(tuple(r) for r in labels.spans(df).collect()) == [(1, 0, "X", "t0 t1"), (1, 4, "X", "t4"), (1, 5, "Y", "t5 t6")]


def site():
    link = lambda *to: "".join(f"<p><a href='{t}'>alpha beta</a></p>" for t in to)
    body = lambda inner: f"<html><title>T</title><body><article><p>alpha beta {'word ' * 60}</p><code>def f(): alpha</code>{inner}</article></body></html>"
    return [
        ("http://a.com/", body(link("/b", "c", "http://other.com/x", "/pic.PNG", "mailto:x@y", "#top", "/gone"))),
        ("http://a.com/b", body(link("/d", "/"))),
        ("http://a.com/c", body(link("/e"))),
        ("http://a.com/d", body(link("/f"))),
        ("http://a.com/e", body("")),
        ("http://a.com/f", body(link("/g"))),
        ("http://a.com/g", body("")),
        ("http://a.com:8080/z", body(link("/b"))),
    ]


@pytest.fixture(scope="module")
def site_pages(spark):
    return spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(site())], "page_id long, url string, html string")


def test_links(site_pages):
    got = {r["dst"] for r in links.relevant(links.anchors(site_pages), KEYWORDS).where("url = 'http://a.com/'").collect()}
    assert got == {"http://a.com/b", "http://a.com/c", "http://a.com/gone", "http://a.com/#top"}


def test_crawl_is_best_first(spark, site_pages):
    seeds = spark.createDataFrame([("http://a.com/",), ("http://a.com:8080/z",), ("http://none.com/",)], "seed string")
    out = crawl.best_first(site_pages, seeds, KEYWORDS, max_depth=2, max_pages=20)
    steps = [(r["url"], r["depth"], r["found"]) for r in out.where("seed = 'http://a.com/'").orderBy("step").collect()]
    assert steps == [("http://a.com/", 0, True), ("http://a.com/#top", 1, False), ("http://a.com/b", 1, True), ("http://a.com/c", 1, True), ("http://a.com/d", 2, True), ("http://a.com/e", 2, True), ("http://a.com/gone", 1, False), ("http://a.com/pic.PNG", 1, False)]
    assert out.where("seed = 'http://none.com/'").count() == 1
    assert crawl.best_first(site_pages, seeds.limit(1), KEYWORDS, max_depth=3, max_pages=3).count() == 3


def test_documents_and_client(spark, site_pages, tmp_path):
    docs = documents.rag_documents(site_pages, KEYWORDS).collect()
    assert len(docs) == 8 and docs[0]["types"] == ["code", "text"] and docs[0]["technical_content"][0]["language"] == "python"
    with pytest.raises(ValueError):
        WebClient(spark, "")
    path = tmp_path / "o" / "x.json"
    found = WebClient(spark, "k").scrape(site_pages, "http://a.com/", "alpha beta", str(path), 2)
    saved = json.loads(path.read_text())
    assert len(saved) == found.count() == 5 and saved[0]["title"] == "T" and saved[0]["chunk_count"] >= 1
    assert sinks.save_list(found.where("false"), str(tmp_path / "none.json")) is None
    sinks.write_json(found, str(tmp_path / "many"))
    assert spark.read.json(str(tmp_path / "many")).count() == 5


def test_fetch_tries_again():
    tries = []

    def get(url, timeout):
        tries.append(url)
        if len(tries) < 3:
            raise OSError
        return "html"

    assert pages.fetch("u", wait=0, get=get) == "html" and len(tries) == 3
    assert pages.fetch("u", retries=1, wait=0, get=lambda *_: (_ for _ in ()).throw(OSError())) is None


def test_prompt(spark):
    q = prompt.query("Find React docs about the Alpha Beta state")
    assert q.keywords == ["alpha", "beta", "docs", "react", "state"] and q.entities == {"name": ["alpha beta", "react"]}
    assert "jsx" in prompt.expanded_keywords(q)
    r = spark.createDataFrame([(q.instructions_summary,)], "t string").select(prompt.keywords(F.col("t")).alias("k"), prompt.expanded(F.col("t"), prompt.keywords(F.col("t"))).alias("e"), prompt.entities(F.col("t")).alias("n")).first()
    assert r["k"] == q.keywords and r["e"] == prompt.expanded_keywords(q) and r["n"] == q.entities


def test_stream(spark, site_pages, tmp_path):
    site_pages.repartition(3).write.parquet(str(tmp_path / "in"))
    q = stream.write_documents(stream.arriving(spark, str(tmp_path / "in"), 1), prompt.query("alpha beta"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def test_crawl_query_has_the_whole_budget(spark, monkeypatch):
    import inspect

    from weblode.plans import registry

    best_first, asked = crawl.best_first, {}

    def watched(*args, **named):
        asked.update(inspect.signature(best_first).bind(*args, **named).arguments)
        return args[1]

    monkeypatch.setattr(crawl, "best_first", watched)
    registry.queries()["crawl_best_first"](spark, "/root/testdata/sf0.001")
    assert asked.get("max_depth", 3) == 3 and asked.get("max_pages", 20) == 20


def test_label_models_vote_on_slices(spark):
    from weblode.operators import labels

    def model(shift):
        return lambda texts: [[(w, ("B-X", "I-X", "O")[(len(w) + shift * (k % 2)) % 3]) for k, w in enumerate(t.split())] for t in texts]

    docs = spark.createDataFrame([(1, "one three five"), (2, None), (3, ""), (4, "ab " * 300)], "doc_id long, text string")
    out = labels.labelled(docs, (model(0), model(0), model(1))).collect()
    assert [(r["pos"], r["token"], r["label"]) for r in sorted(out, key=lambda r: r["pos"]) if r["doc_id"] == 1] == [(0, "one", "B-X"), (1, "three", "O"), (2, "five", "I-X")]
    assert {r["doc_id"] for r in out} == {1, 4} and sorted(r["pos"] for r in out if r["doc_id"] == 4) == list(range(len([r for r in out if r["doc_id"] == 4])))
    assert labels.spans(spark.createDataFrame(out)).where("doc_id = 1").count() == 1


def test_analyse_gives_the_four_sets(spark):
    from weblode.functions import patterns
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([("class Foo extends Bar { render() } uses a REST api with state-of-the-art components",), ("",)], "text string")
    for r in docs.select(patterns.analyse(F.col("text")).alias("a"), patterns.syntax(F.col("text")).alias("s"), patterns.technical_terms(F.col("text")).alias("t"), patterns.structured(F.col("text")).alias("u"), patterns.domains(F.col("text")).alias("d")).collect():
        assert tuple(r["a"]) == (r["s"], r["t"], r["u"], r["d"])


def test_has_code_and_chunks_of_a_fixture_page():
    from weblode.sources.html import parse

    page = "<html><head><title>T</title><meta name='description' content='about'></head><body><nav class='menu'>go</nav><article><p>text</p><div><pre><code class='language-python'>import x</code></pre></div></article><table><tr><th>h</th></tr><tr><td>c</td></tr></table></body></html>"
    found = parse(page, ("title", "meta", "nodes", "code", "tables"))
    has = {n["tag"]: n["has_code"] for n in found["nodes"]}
    assert has["article"] and has["div"] and has["pre"] and has["body"] and not has["code"] and not has["p"] and not has["table"]
    assert found["title"] == "T" and found["meta"] == [("description", "about")] and [c["in_article"] for c in found["code"]] == [True, True] and found["tables"][0]["headers"] == ["h"]
    assert [n["tag"] for n in found["nodes"] if n["navigation"]] == ["nav"]


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dear_values_are_computed_once(spark):
    rows = spark.createDataFrame([(1, "u", "<article>alpha() data</article>", "alpha")], "page_id int, url string, html string, text string")
    for df in (documents.element_chunks(rows, KEYWORDS), documents.rag_documents(rows, KEYWORDS), documents.article_chunks(rows, KEYWORDS)):
        assert planned(df).count("cookie policy") == 1
    for column in (score.quick, score.content, lambda t, k: score.semantic(t, k, {"a": ["x", "y"]}), lambda t, k: classify.chunk_type(t), lambda t, k: classify.indicators(t), classify.labels):
        assert planned(rows.select(column(F.col("text"), KEYWORDS).alias("v"))).count("lower(") == 1


def test_pattern_stats_searches_texts_once(spark, tmp_path):
    spark.createDataFrame([(1, "try @x"), (2, "try")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.queries()["pattern_stats"](spark, str(tmp_path))
    assert planned(df).count("try|catch") == 1
    assert [tuple(r) for r in df.collect()] == [("error_handling", 2, 2), ("decorator_annotation", 1, 2)]


def test_signs_pass_over_no_match(spark):
    pieces = "f(a) {|f ( )|Class X|INTERFACE|import a;|IMPORT {a} from|Require\n|let x = 'v'|>|</a>|<a>b</a>|a: b;|SELECT x FROM t|@d|aWait|Try|[x]|\"k\":|k=\"v\"|12px|3.5EM|7%x|5rem|www.a|http://a|{ w :|const f=|K=|İ|SELİECT|_|insert\tinto|update|function f(x)|\n".split("|")
    rng = random.Random(5)
    texts = [" ".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    low = F.lower(t)
    tests = [("(?im)" + p, patterns.SIGNS[n]) for n, p in patterns.SYNTAX.items()] + [("(?m)" + p, patterns.SIGNS[n]) for n, p in patterns.STRUCTURED.items()]
    tests += [("(?i)" + p, s) for (_, p), s in zip(classify.KINDS, classify.KIND_SIGNS, strict=True)] + list(zip(score.CODE_LIKE, score.CODE_SIGNS, strict=True))
    found = df.agg(*[F.struct(F.sum(t.rlike(p).cast("int")), F.sum((t.rlike(p) & ~text.holding(low, s)).cast("int"))) for p, s in tests]).first()
    assert [p for (p, _), (n, missed) in zip(tests, found, strict=True) if not n or missed] == []


def test_word_bounds_stop_splitting_but_count_the_same(spark):
    texts = ["", " ", "a", " a b ", "a b c", "\ta\n b\x0bc d ", "a b c d e f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = df.select(text.has_words(F.col("t"), 3), text.first_words(F.col("t"), 2), text.word_count(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(len(t.split()) >= 3, " ".join(t.split()[:2]), len(t.split())) for t in texts]


def test_crawl_reads_pages_few_times(spark, site_pages):
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            read.add(len(f))
            yield f

    many = site_pages.count()
    crawl.best_first(site_pages.mapInPandas(counted, site_pages.schema), spark.createDataFrame([("http://a.com/",)], "seed string"), KEYWORDS).count()
    assert many <= read.value <= 2 * many


def test_resolving_runs_no_python_beside_the_parser(spark):
    hrefs = ["/a", "//h/x", "b c", "/a/../b", "/.hid", "?q", "", "#f", "http://o.com/z", "mailto:x@y", "http://[bad", "/é", "/a b", "/x/.", "/u ", "../.."]
    for url in ("http://a.com/p/q?r", "/no/origin", ""):
        page = "".join(f'<a href="{h}">t</a>' for h in hrefs)
        got = links.resolved(links.anchors(spark.createDataFrame([(1, url, page)], "page_id int, url string, html string")))
        plain = links.resolved(spark.createDataFrame([(k, url, h) for k, h in enumerate(hrefs)], "ord int, url string, href string"))
        assert "joined" not in got.columns and "ArrowEvalPython" not in planned(got)
        assert [tuple(r) for r in got.orderBy("ord").select("href", "dst").collect()] == [tuple(r) for r in plain.orderBy("ord").select("href", "dst").collect()]


def test_spans_of_texts_take_no_exchange(spark, tmp_path):
    tags = ["I-A", "B-X", "I-X", None, "I-Z", "O", "I-X", "B-X", "B-Y", "I-Z"]
    rows = spark.createDataFrame([(d, k, f"t{k}", t) for d in (1, 2) for k, t in enumerate(tags)] + [(3, 0, "t", "O")], "doc_id long, pos int, token string, label string")
    want = [(d, *s) for d in (1, 2) for s in [(1, "X", "t1 t2 t4"), (7, "X", "t7"), (8, "Y", "t8 t9")]]
    assert sorted(tuple(r) for r in labels.spans(rows).collect()) == want
    texts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "label"))).alias("tokens")).unionByName(spark.createDataFrame([(4, [])], "doc_id long, tokens array<struct<pos:int,token:string,label:string>>"))
    assert sorted(tuple(r) for r in labels.spans(texts).collect()) == want
    found = labels.with_context(spark.createDataFrame([(1, "c")], "doc_id long, context string"), rows)
    assert found.columns == ["doc_id", "start", "type", "entity", "context", "confidence"] and found.count() == 3
    spark.createDataFrame([(1, "a bb ccc", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spans, context = (planned(registry.queries()[n](spark, str(tmp_path))) for n in ("bio_spans", "entities_with_context"))
    assert not any(x in spans for x in ("Window", "Aggregate", "Sort")) and not any(x in context for x in ("Window", "Aggregate"))
    assert context.count("split(text") == 1
