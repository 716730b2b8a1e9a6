"""Names of the engine's own queries, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weblode.functions import chunk, classify, patterns, score, text
from weblode.operators import crawl, documents, labels, links, prompt
from weblode.plans import sql as S
from weblode.sources import html, pages
from weblode.sources.pages import table

KW, ENT = score.KEYWORDS, score.ENTITIES
QUERY = prompt.Query(KW, ENT, "pages about data and license state")
Run = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Run] = {}
_sql: dict[str, str] = {}


def _add(name: str, run: Run, sql: str | None = None) -> None:
    _queries[name] = run
    if sql:
        _sql[name] = sql


def _docs(name: str, alias: str, column: Callable[[Column], Column], expression: str) -> None:
    """A scalar or array of each document's text."""
    _add(name, lambda s, d: table(s, d, "documents").select("doc_id", column(F.col("text")).alias(alias)), f"SELECT doc_id, {expression} AS {alias} FROM documents")


def _pieces(name: str, column: Callable[[Column], Column], expression: str) -> None:
    """The elements of an array of each document's text, in order."""
    _add(
        name,
        lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(column(F.col("text"))).alias("ord", "piece")),
        f"SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS ord, unnest(p) AS piece FROM (SELECT doc_id, {expression} AS p FROM documents)",
    )


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def _field(name: str, field: str) -> Run:
    return lambda s, d: html.parsed(_pages(s, d), (field,)).select("page_id", F.col(field).alias("text"))


# pages as they are
_add("scan_pages", lambda s, d: pages.described(_pages(s, d)), "SELECT page_id, url, md5(url) AS md5_id, CAST(length(html) AS INTEGER) AS n_chars FROM pages")
_add(
    "dedup_pages",
    lambda s, d: pages.described(pages.one_per_url(_pages(s, d).unionByName(_pages(s, d).withColumn("page_id", F.col("page_id") + 1_000_000)))),
    "SELECT min(page_id) AS page_id, url, md5(url) AS md5_id, CAST(length(arg_min(html, page_id)) AS INTEGER) AS n_chars FROM pages GROUP BY url",
)
_add(
    "fetch_pages",
    lambda s, d: pages.fetched(_pages(s, d).select("url").unionByName(s.createDataFrame([("https://nowhere.example.com/",)], "url string")), _pages(s, d)).select("url", F.col("html").isNotNull().alias("fetched")),
    "SELECT url, true AS fetched FROM pages UNION ALL SELECT 'https://nowhere.example.com/', false",
)
_docs("content_hash", "md5_id", text.content_id, "md5(text)")

# text
T = "text"
_docs("clean_text_code", "cleaned", text.clean_code, S.clean_code(T))
_docs("clean_text_plain", "cleaned", text.clean_plain, S.clean_plain(T))
_docs("word_count", "n_words", text.word_count, f"CAST(len({S.words(T)}) AS INTEGER)")
_add(
    "vocab_diversity",
    lambda s, d: table(s, d, "documents").select("doc_id", text.diversity(F.col("text"), True).alias("smoothed"), text.diversity(F.col("text"), False).alias("plain")),
    f"SELECT doc_id, len(list_distinct(w))::DOUBLE / (len(w) + 1) AS smoothed, len(list_distinct(w))::DOUBLE / nullif(len(w), 0) AS plain FROM (SELECT doc_id, {S.words(T)} AS w FROM documents)",
)
_docs("truncate_words", "truncated", text.first_words, f"array_to_string({S.words(T)}[1:200], ' ')")
_docs("truncate_chars", "truncated", lambda t: F.substring(t, 1, 100), "substring(text, 1, 100)")
_pieces("char_windows", text.char_windows, "list_transform(range(0, length(text), 512), lambda i: substring(text, i + 1, 512))")
_pieces("context_windows", text.context_windows, S.groups(S.words(T), 50, 25))
_pieces("sentences", chunk.sentences, S.sentences(T))
_pieces("split_long", lambda t: text.groups_of_words(t, 20), S.groups(S.words(T), 20))

CHUNKS = f"""sent AS (
  SELECT doc_id, source, generate_subscripts(p, 1) AS k, unnest(p) AS s FROM (SELECT doc_id, source, {S.sentences(T)} AS p FROM documents)
), counted AS (SELECT doc_id, source, k, s, len({S.words('s')}) AS n FROM sent),
packed AS (
  SELECT doc_id, source, k, s, n, CAST(1 AS BIGINT) AS c, CASE WHEN n > 50 THEN 0 ELSE n END AS size FROM counted WHERE k = 1
  UNION ALL
  SELECT b.doc_id, b.source, b.k, b.s, b.n, a.c + CASE WHEN b.n > 50 OR a.n > 50 OR a.size + b.n > 50 THEN 1 ELSE 0 END,
    CASE WHEN b.n > 50 THEN 0 WHEN a.n > 50 OR a.size + b.n > 50 THEN b.n ELSE a.size + b.n END
  FROM packed a JOIN counted b ON b.doc_id = a.doc_id AND b.k = a.k + 1
), whole AS (SELECT doc_id, source, c, 0 AS part, string_agg(s, ' ' ORDER BY k) AS piece FROM packed WHERE n <= 50 GROUP BY doc_id, source, c),
cut AS (
  SELECT doc_id, source, c, generate_subscripts(g, 1) AS part, unnest(g) AS piece FROM (SELECT doc_id, source, c, {S.groups(S.words('s'), 50)} AS g FROM packed WHERE n > 50)
), chunks AS (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY c, part) - 1 AS INTEGER) AS ord, piece FROM (SELECT * FROM whole UNION ALL SELECT * FROM cut))"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(chunk.semantic_chunks(F.col("text"), 50)).alias("ord", "piece"))


_add("semantic_chunks", lambda s, d: _chunks(s, d).select("doc_id", "ord", "piece"), f"WITH RECURSIVE {CHUNKS} SELECT doc_id, ord, piece FROM chunks")

# labels of text
_docs("chunk_type", "chunk_type", classify.chunk_type, S.chunk_type(T))
_docs("tech_indicators", "indicators", lambda t: F.array_join(classify.indicators(t), ","), f"array_to_string({S.indicators(T)}, ',')")
_docs("keywords_found", "found", lambda t: F.array_join(classify.keywords_found(t, KW), ","), f"array_to_string(list_filter({S.KEYWORD_SQL}, lambda k: contains(lower(text), k)), ',')")
_docs("code_language", "language", classify.code_language, S.code_language(T))

# scores
_docs("quick_relevance", "score", lambda t: score.quick(t, KW), S.quick(T))
_docs("content_relevance", "score", lambda t: score.content(t, KW), S.content(T))
_add(
    "semantic_score",
    lambda s, d: table(s, d, "documents").select("doc_id", score.semantic(F.col("text"), KW, ENT).alias("score")),
    f"SELECT doc_id, CASE WHEN text = '' THEN 0.0::DOUBLE ELSE {S.semantic(T)} END AS score FROM (SELECT doc_id, text, array_to_string({S.words(T)}[1:200], ' ') AS sample FROM documents)",
)
_docs("text_relevance", "score", lambda t: score.mentions(t, KW, ENT), S.mentions(T))


# aggregates over chunks
def _scored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).withColumn("score", score.content(F.col("piece"), KW))


SCORED = f"{CHUNKS}, scored AS (SELECT *, {S.content('piece')} AS score FROM chunks)"
_mean = lambda c: F.round(F.avg(c), 9)
_add("doc_relevance", lambda s, d: _scored_chunks(s, d).groupBy("source").agg(F.coalesce(_mean("score"), F.lit(0.0)).alias("relevance")), f"WITH RECURSIVE {SCORED} SELECT source, coalesce(round(avg(score), 9), 0.0) AS relevance FROM scored GROUP BY source")
_add("avg_relevance", lambda s, d: documents.at_least(_chunks(s, d), "score", score.content(F.col("piece"), KW), 0.3).groupBy("doc_id").agg(_mean("score").alias("relevance")), f"WITH RECURSIVE {SCORED} SELECT doc_id, round(avg(score), 9) AS relevance FROM scored WHERE score > 0.3::DOUBLE GROUP BY doc_id")
_add("chunk_counts", lambda s, d: _chunks(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("chunks")), f"WITH RECURSIVE {CHUNKS} SELECT source, count(*) AS chunks FROM chunks GROUP BY source")
_add(
    "doc_concepts",
    lambda s, d: _chunks(s, d).groupBy("source").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(classify.indicators(F.col("piece")))))), ",").alias("concepts"), F.array_join(F.array_sort(F.collect_set(classify.chunk_type(F.col("piece")))), ",").alias("types")),
    f"WITH RECURSIVE {CHUNKS} SELECT source, array_to_string(list_sort(list_distinct(flatten(list({S.indicators('piece')})))), ',') AS concepts, array_to_string(list_sort(list_distinct(list({S.chunk_type('piece')}))), ',') AS types FROM chunks GROUP BY source",
)


def _page_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "ord"))
    return _scored_chunks(spark, sf_dir).withColumn("rank", rank).groupBy("doc_id").agg(F.round(score.ranked_mean(F.col("score"), F.col("rank")), 9).alias("relevance"))


_add("page_relevance", _page_relevance, f"WITH RECURSIVE {SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS rank FROM scored) SELECT doc_id, round(least(1.0, sum(score / rank) / sum(1.0::DOUBLE / rank)), 9) AS relevance FROM ranked GROUP BY doc_id")

# pages parsed
_add("page_title", _field("page_title", "title"), f"SELECT page_id, {S.decoded('''regexp_extract(html, '<title>(.*?)</title>', 1)''')} AS text FROM pages")
_add("page_meta", lambda s, d: html.parsed(_pages(s, d), ("meta",)).select("page_id", F.size("meta").alias("n_meta"), F.col("meta")["description"].alias("description")), "SELECT page_id, CAST(0 AS INTEGER) AS n_meta, CAST(NULL AS VARCHAR) AS description FROM pages")
_add("article_text", _field("article_text", "article_text"), f"SELECT page_id, {S.stripped(S.ARTICLE)} AS text FROM pages")
_add("main_content", _field("main_content", "main_text"), f"SELECT page_id, {S.stripped(S.ARTICLE)} AS text FROM pages")
_add("clean_main", _field("clean_main", "clean_text"), f"SELECT page_id, {S.stripped(S.ARTICLE)} AS text FROM pages")
ARTICLE_RAW = S.decoded(f"regexp_replace({S.ARTICLE}, '<[^>]*>', '', 'g')")
ONE = f"one AS (SELECT page_id, url, {S.clean_code(ARTICLE_RAW)} AS content, {S.decoded('''regexp_extract(html, '<title>(.*?)</title>', 1)''')} AS title FROM pages), rated AS (SELECT *, {S.content('content')} AS relevance FROM one WHERE content <> '')"
_add("article_chunks", lambda s, d: documents.article_chunks(_pages(s, d), KW).select("page_id", "ord", "type", "id", "relevance"), f"WITH {ONE} SELECT page_id, CAST(0 AS INTEGER) AS ord, 'text' AS type, md5(content) AS id, relevance FROM rated")
_add(
    "rag_documents",
    lambda s, d: documents.rag_documents(_pages(s, d), KW).select("page_id", "url", "title", "chunk_count", F.array_join("types", ",").alias("types"), "average_relevance"),
    f"WITH {ONE} SELECT page_id, url, title, CAST(1 AS BIGINT) AS chunk_count, 'text' AS types, relevance AS average_relevance FROM rated WHERE relevance > 0.3::DOUBLE ORDER BY relevance DESC, url",
)
_add("ranked_docs", lambda s, d: documents.rag_documents(_pages(s, d), KW).select("page_id", "average_relevance", F.row_number().over(Window.orderBy(F.desc("average_relevance"), "url", "page_id")).alias("rank")), f"WITH {ONE} SELECT page_id, relevance AS average_relevance, CAST(row_number() OVER (ORDER BY relevance DESC, url, page_id) AS INTEGER) AS rank FROM rated WHERE relevance > 0.3::DOUBLE")
_add("json_docs", lambda s, d: documents.rag_documents(_pages(s, d), KW).select("page_id", F.to_json(F.struct("url", "chunk_count")).alias("json")), f"WITH {ONE} SELECT page_id, '{{\"url\":\"' || url || '\",\"chunk_count\":1}}' AS json FROM rated WHERE relevance > 0.3::DOUBLE")

# links
_anchors = lambda s, d: links.anchors(_pages(s, d))
_resolved = lambda s, d: links.resolved(_anchors(s, d))
L = f"WITH {S.LINKS}"
_add("page_links", lambda s, d: _anchors(s, d).select("page_id", "ord", "href", "text"), f"{L} SELECT page_id, ord, href, text FROM anchors")
_add("resolve_links", lambda s, d: _resolved(s, d).select("page_id", "ord", "dst"), f"{L} SELECT page_id, ord, dst FROM resolved")
_add("same_site_links", lambda s, d: links.same_site(_resolved(s, d)).select("page_id", "ord", "dst"), f"{L} SELECT page_id, ord, dst FROM resolved")
_add("nonmedia_links", lambda s, d: links.no_media(_resolved(s, d)).select("page_id", "ord", "dst"), rf"{L} SELECT page_id, ord, dst FROM resolved WHERE NOT regexp_matches(dst, '(?i)\.(gif|png|jpe?g|pdf|docx?)$')")
_add("unvisited_links", lambda s, d: links.unvisited(_resolved(s, d), _resolved(s, d).where("page_id % 3 = 0").select(F.col("dst").alias("url"))).select("page_id", "ord", "dst"), f"{L} SELECT page_id, ord, dst FROM resolved WHERE dst NOT IN (SELECT dst FROM resolved WHERE page_id % 3 = 0)")
_add("url_relevance", lambda s, d: links.scored(_resolved(s, d), KW).select("page_id", "ord", "dst", "score"), f"{L} SELECT page_id, ord, dst, {S.url_score()} AS score FROM resolved")
_add("relevant_links", lambda s, d: links.relevant(_anchors(s, d), KW).select("page_id", "ord", "dst", "score"), rf"{L}, scored AS (SELECT *, {S.url_score()} AS score FROM resolved WHERE NOT regexp_matches(dst, '(?i)\.(gif|png|jpe?g|pdf|docx?)$')) SELECT page_id, ord, dst, score FROM scored WHERE score > 0.2::DOUBLE")
_add(
    "initial_links",
    lambda s, d: links.seeds(_anchors(s, d), KW).select("page_id", "dst", "score", "rank"),
    f"{L}, scored AS (SELECT page_id, dst, max({S.seed_score()}) AS score FROM resolved GROUP BY page_id, dst), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, dst DESC) AS INTEGER) AS rank FROM scored WHERE score > 0.4::DOUBLE) SELECT page_id, dst, score, rank FROM ranked WHERE rank <= 10",
)

# patterns
_docs("syntax_patterns", "found", lambda t: F.array_join(patterns.syntax(t), ","), f"array_to_string({S.syntax(T)}, ',')")
_docs("technical_terms", "found", lambda t: F.array_join(patterns.technical_terms(t), "|"), f"array_to_string({S.technical_terms(T)}, '|')")
_docs("structured_data", "found", lambda t: F.array_join(patterns.structured(t), ","), f"array_to_string({S.structured(T)}, ',')")
_add(
    "domain_patterns",
    lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(patterns.domains(F.col("text")), ",").alias("found")),
    f"WITH w AS (SELECT doc_id, unnest(p) AS x FROM (SELECT doc_id, {S.groups(S.words(T), 50, 25)} AS p FROM documents)), hit AS (SELECT doc_id, x FROM w WHERE {S.has_context('x')}), "
    + "named AS (" + " UNION ".join(f"SELECT doc_id, {S.q(n)} AS d FROM hit WHERE regexp_matches(x, {S.q(f'(?i){S.PRE}(?:{p}){S.POST}')})" for n, p in sorted(patterns.DOMAINS.items())) + ") SELECT doc_id, coalesce(string_agg(d, ',' ORDER BY d), '') AS found FROM (SELECT doc_id FROM documents) LEFT JOIN named USING (doc_id) GROUP BY doc_id",
)


def _found_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.concat(patterns.syntax(F.col("text")), patterns.structured(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 100).alias("example"), F.explode(both).alias("pattern"))


FOUND = f"found AS (SELECT doc_id, substring(text, 1, 100) AS example, unnest({S.syntax(T)} || {S.structured(T)}) AS pattern FROM documents)"
_add("pattern_counts", lambda s, d: _found_patterns(s, d).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), f"WITH {FOUND} SELECT pattern, count(*) AS n FROM found GROUP BY pattern")


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _found_patterns(spark, sf_dir).groupBy("pattern", "example").agg(F.min("doc_id").alias("doc_id"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("pattern").orderBy("doc_id"))).where("rank <= 5").select("pattern", "rank", "example")


_add("pattern_examples", _examples, f"WITH {FOUND}, first AS (SELECT pattern, example, min(doc_id) AS doc_id FROM found GROUP BY pattern, example), r AS (SELECT pattern, example, CAST(row_number() OVER (PARTITION BY pattern ORDER BY doc_id) AS INTEGER) AS rank FROM first) SELECT pattern, rank, example FROM r WHERE rank <= 5")


def _pattern_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the texts are searched once: the number of patterns is counted beside the few rows of counts
    counts = _found_patterns(spark, sf_dir).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total_patterns", F.count(F.lit(1)).over(Window.partitionBy())).orderBy(F.desc("n"), "pattern").limit(10)


_add("pattern_stats", _pattern_stats, f"WITH {FOUND}, c AS (SELECT pattern, count(*) AS n FROM found GROUP BY pattern) SELECT pattern, n, (SELECT count(*) FROM c) AS total_patterns FROM c ORDER BY n DESC, pattern LIMIT 10")

# labels of tokens: made from places and lengths, as there is no model to give them
_mod = {0: "B-PER", 1: "I-PER", 2: "O", 3: "B-LOC", 4: "I-LOC"}
_label = lambda e: F.element_at(F.array(*[F.lit(v) for v in _mod.values()]), e % 5 + 1)
TOKENS = f"tok AS (SELECT doc_id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos, unnest(w) AS token FROM (SELECT doc_id, {S.words(T)}[1:200] AS w FROM documents))"
_case = lambda e: "[" + ", ".join(S.q(v) for v in _mod.values()) + f"][CAST({e} % 5 + 1 AS INTEGER)]"
VOTES = f"{TOKENS}, lab AS (SELECT *, {_case('(pos + length(token))')} AS a, {_case('(pos * 2 + length(token))')} AS b, {_case('(doc_id + pos)')} AS c FROM tok), voted AS (SELECT doc_id, pos, token, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE a END AS label FROM lab)"


def _voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.tokens(table(spark, sf_dir, "documents")).withColumn("label", _vote(F.col("token"), F.col("pos")))


def _vote(token: Column, pos: Column) -> Column:
    n = F.length(token)
    return labels.vote(_label(pos + n), _label(pos * 2 + n), _label((F.col("doc_id") + pos).cast("int")))


def _voted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, a row a text: its tokens needn't be brought together again."""
    tokens = F.transform(labels.first_tokens(F.col("text")), lambda t, k: F.struct(k.alias("pos"), t.alias("token"), _vote(t, k).alias("label")))
    return table(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens"))


_add("label_vote", _voted, f"WITH {VOTES} SELECT doc_id, pos, token, label FROM voted")
_add(
    "bio_spans",
    lambda s, d: labels.spans(_voted_texts(s, d)),
    f"WITH {VOTES}, runs AS (SELECT *, sum(CASE WHEN label LIKE 'I-%' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM voted), heads AS (SELECT *, first_value(label) OVER (PARTITION BY doc_id, run ORDER BY pos) AS head FROM runs) SELECT doc_id, min(pos) AS start, any_value(substring(head, 3)) AS type, string_agg(token, ' ' ORDER BY pos) AS entity FROM heads WHERE head LIKE 'B-%' GROUP BY doc_id, run",
)
_add("entities_with_context", lambda s, d: labels.with_context(table(s, d, "documents").select("doc_id", F.col("source").alias("context")), _voted_texts(s, d)))

# instructions
_turns = lambda s, d: table(s, d, "conversations").where("role = 'user'")
_add("prompt_keywords", lambda s, d: _turns(s, d).select("conv_id", "turn", F.array_join(prompt.keywords(F.col("text")), ",").alias("keywords")), f"SELECT conv_id, turn, array_to_string({S.keywords(T)}, ',') AS keywords FROM conversations WHERE role = 'user'")
_add("keyword_expand", lambda s, d: _turns(s, d).select("conv_id", "turn", F.array_join(prompt.expanded(F.col("text"), prompt.keywords(F.col("text"))), ",").alias("keywords")), f"SELECT conv_id, turn, array_to_string({S.expanded(T)}, ',') AS keywords FROM conversations WHERE role = 'user'")
_add("prompt_entities", lambda s, d: _turns(s, d).select("conv_id", "turn", F.array_join(F.coalesce(F.try_element_at(prompt.entities(F.col("text")), F.lit("name")), F.array().cast("array<string>")), "|").alias("names")))

# what only a parser of markup can give: rows alone are compared
_add("html_nodes", lambda s, d: documents.nodes(_pages(s, d)).select("page_id", "node_id", "parent_id", "depth", "tag", F.length("text").alias("n_chars")))
_add("html_tree", lambda s, d: documents.nodes(_pages(s, d), main=True).select("page_id", "node_id", "parent_id", "depth", "tag", "text"))
_add("nav_elements", lambda s, d: documents.nodes(_pages(s, d)).where("navigation").select("page_id", "node_id", "tag"))
_add("section_scan", lambda s, d: documents.sections(_pages(s, d), KW).select("page_id", "node_id", "tag", "quick_score"))
_add("section_topk", lambda s, d: documents.top_sections(_pages(s, d), KW).select("page_id", "node_id", "rank", "quick_score"))
_add("relevant_sections", lambda s, d: documents.relevant_sections(_pages(s, d), QUERY).select("page_id", "node_id", "rank", "score"))
_add("section_chunks", lambda s, d: documents.section_chunks(documents.relevant_sections(_pages(s, d), QUERY), KW).select("page_id", "rank", "part", "chunk_id", "chunk_type", "score", "word_count"))
_add("content_elements", lambda s, d: documents.content_elements(_pages(s, d), KW).select("page_id", "node_id", "relevance"))
_add("content_chunks", lambda s, d: documents.content_chunks(_pages(s, d), KW).select("page_id", "kind", "ord", "id", "relevance"))
_add("element_chunks", lambda s, d: documents.element_chunks(_pages(s, d), KW).select("page_id", "node_id", "id", "relevance"))
_add("table_chunks", lambda s, d: documents.table_chunks(_pages(s, d).withColumn("html", F.concat(F.lit("<table><tr><th>data</th><th>state</th></tr><tr><td>the license</td><td>"), F.col("url"), F.lit("</td></tr></table>"))), KW).select("page_id", "id", "relevance", "row_count", "column_count"))
_add("nested_docs", lambda s, d: documents.parsed_documents(_pages(s, d), QUERY).select("page_id", "url", "title", "relevance_score", "chunk_count", "content_types", "technical_concepts"))
_add("final_docs", lambda s, d: documents.final_documents(_pages(s, d), QUERY, KW).select("page_id", "url", "title", "relevance_score", "chunk_count", F.size("technical_content").alias("n_technical")))


def _crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl from every page, over pages to which addresses are added so that links lead somewhere: each path word of a site gets its page."""
    have = _pages(spark, sf_dir).select("page_id", "url", "html")
    dst = links.relevant(links.anchors(have), KW).select("dst", "page_id").groupBy("dst").agg(F.min("page_id").alias("page_id"))
    more = dst.join(have.select("page_id", "html"), "page_id").select("page_id", F.col("dst").alias("url"), "html")
    return crawl.best_first(have.unionByName(more), have.select(F.col("url").alias("seed")), KW)


_add("crawl_best_first", _crawl)


def queries() -> dict[str, Run]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
