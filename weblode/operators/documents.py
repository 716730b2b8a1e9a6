"""Sections, chunks and documents of pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weblode.functions import classify, score
from weblode.functions.chunk import semantic_chunks
from weblode.functions.text import any_of, clean_code, content_id, has_words, let, sub_tokens, word_count
from weblode.operators.prompt import Query
from weblode.sources.html import parsed

MARKS = tuple("code pre script sql react javascript".split())


# chunks straight from the markup

def article_chunks(pages: DataFrame, keywords: list[str]) -> DataFrame:
    """(page_id, url, ord, type, content, id, language, relevance): a page's article as one chunk of cleaned text, then each pre and code in it.

    Code is worth 0.2 more, on top of the cap. Pages without an article have none.
    """
    return _article_chunks(parsed(pages, ("article", "code")), keywords)


def _article_chunks(found: DataFrame, keywords: list[str]) -> DataFrame:
    """The chunks of pages parsed to article and code, and what else they were parsed to; one pass, as all parts of a page are one array."""
    others = [c for c in found.columns if c not in ("page_id", "url", "article", "code")]
    part = lambda ord_, type_, text, classes: F.struct(F.lit(ord_).cast("int").alias("ord") if isinstance(ord_, int) else ord_.alias("ord"), F.lit(type_).alias("type"), text.alias("text"), classes.alias("classes"))
    text = F.when(F.col("article").isNotNull(), F.array(part(0, "text", F.col("article"), F.array().cast("array<string>")))).otherwise(F.array())
    coded = F.transform("code", lambda c, k: F.when(c["in_article"], part((k + 1).cast("int"), "code", c["text"], c["classes"])))
    parts = F.concat(text, F.filter(F.coalesce(coded, F.array()), lambda c: c.isNotNull()))
    rows = found.select("page_id", "url", *others, F.explode(parts).alias("p")).select("page_id", "url", *others, "p.*")
    rows = only(rows, "content", clean_code(F.col("text")), lambda c: c != "")
    relevance = score.content(F.col("content"), keywords) + F.when(F.col("type") == "code", F.lit(0.2)).otherwise(F.lit(0.0))
    language = F.when(F.col("type") == "code", classify.code_language(F.col("text"), F.col("classes"))).alias("language")
    return only(rows, "relevance", relevance).select("page_id", "url", *others, "ord", "type", "content", content_id(F.col("content")).alias("id"), language, "relevance")


def rag_documents(pages: DataFrame, keywords: list[str], least: float = 0.3) -> DataFrame:
    """A row a page with chunks over least: title, chunks, their number, types and mean relevance, and the technical ones; best first."""
    chunks = _article_chunks(parsed(pages, ("article", "code", "title")), keywords).where(F.col("relevance") > least)
    item = F.struct("ord", "id", "type", "content", "language", "relevance")
    docs = chunks.groupBy("page_id", "url").agg(
        F.array_sort(F.collect_list(item)).alias("chunks"),
        F.count(F.lit(1)).alias("chunk_count"),
        F.avg("relevance").alias("average_relevance"),
        F.array_sort(F.collect_set("type")).alias("types"),
        F.any_value("title").alias("title"),
    )
    out = docs.withColumn("technical_content", F.filter("chunks", lambda c: c["type"].isin("code", "table")))
    return out.orderBy(F.desc("average_relevance"), "url", "page_id")


def nodes(pages: DataFrame, main: bool = False, markup: bool = False) -> DataFrame:
    """(page_id, url, node_id, parent_id, depth, tag, attributes, classes, text, html, navigation, has_code): elements with text, of the page or its main part.

    html is null unless markup is asked for, which is for whole pages only.
    """
    name = "main_nodes" if main else "nodes_markup" if markup else "nodes"
    return parsed(pages, (name,)).select("page_id", "url", F.explode(name).alias("n")).select("page_id", "url", "n.*")


def content_elements(pages: DataFrame, keywords: list[str]) -> DataFrame:
    """Elements out of navigation with at least 100 signs and a relevance over 0.2, of the text as it is."""
    out = nodes(pages).where("not navigation and length(text) >= 100")
    return at_least(out, "relevance", score.content(F.col("text"), keywords), 0.2)


def element_chunks(pages: DataFrame, keywords: list[str]) -> DataFrame:
    """Elements as chunks; technical markup is worth 0.2 more, and those at 0.2 stay."""
    out = only(nodes(pages, markup=True), "content", clean_code(F.col("text")), lambda c: c != "")
    marked = let(F.lower("html"), lambda low: any_of(low, MARKS))
    out = only(out, "relevance", score.content(F.col("content"), keywords) + F.when(marked, F.lit(0.2)).otherwise(F.lit(0.0)), lambda v: v >= 0.2)
    named = let(F.lower("html"), lambda low: F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in ("react", "javascript", "sql", "code")]))
    named = F.filter(named, lambda x: x.isNotNull())
    meta = F.struct("has_code", named.alias("technical_indicators"))
    return out.select("page_id", "url", "node_id", content_id(F.col("content")).alias("id"), "content", "relevance", F.lit("text").alias("type"), word_count(F.col("content")).alias("word_count"), "html", "tag", "classes", meta.alias("metadata"))


def table_chunks(pages: DataFrame, keywords: list[str]) -> DataFrame:
    """Tables with at least one cell of text and a relevance of 0.2 or more."""
    out = parsed(pages, ("tables",)).select("page_id", "url", F.posexplode("tables").alias("ord", "t")).select("page_id", "url", "ord", "t.*").where("size(rows) > 0")
    text = F.array_join(F.transform("rows", lambda r: F.array_join(r, " ")), " ")
    out = only(out, "relevance", score.content(text, keywords), lambda v: v >= 0.2)
    columns = F.when(F.size("headers") > 0, F.size("headers")).otherwise(F.size(F.col("rows")[0]))
    return out.select("page_id", "url", "ord", F.md5(F.to_json("rows")).alias("id"), F.lit("table").alias("type"), "headers", "rows", "relevance", F.size("rows").alias("row_count"), columns.alias("column_count"), "html")


def content_chunks(pages: DataFrame, keywords: list[str]) -> DataFrame:
    """Text, code and table chunks of whole pages, as (page_id, url, kind, ord, id, content, relevance, html)."""
    text = only(nodes(pages, markup=True).where("tag in ('article', 'section', 'div', 'main') and not navigation"), "content", clean_code(F.col("text")), lambda c: F.length(c) >= 100)
    text = at_least(text, "relevance", score.content(F.col("content"), keywords), 0.2)
    text = text.select("page_id", "url", F.lit("text").alias("kind"), F.col("node_id").alias("ord"), content_id(F.col("content")).alias("id"), "content", "relevance", "html")
    code = parsed(pages, ("code",)).select("page_id", "url", F.posexplode("code").alias("ord", "c"))
    code = only(code, "content", clean_code(F.col("c.stripped")), lambda c: c != "")
    code = code.select("page_id", "url", F.lit("code").alias("kind"), "ord", content_id(F.col("content")).alias("id"), "content", (score.content(F.col("content"), keywords) + 0.2).alias("relevance"), F.lit(None).cast("string").alias("html"))
    tables = table_chunks(pages, keywords).select("page_id", "url", F.lit("table").alias("kind"), "ord", "id", F.to_json("rows").alias("content"), "relevance", "html")
    return text.unionByName(code).unionByName(tables)


def only(rows: DataFrame, name: str, value: Column, fits: Callable[[Column], Column] | None = None) -> DataFrame:
    """rows with the column name = value, if it fits. As an array of one that is filtered, the value is computed once; a filter on a column, here or later, would compute it again, and all that it is made of at each of its uses."""
    return rows.select("*", F.explode(F.filter(F.array(value), fits) if fits else F.array(value)).alias(name))


def at_least(rows: DataFrame, name: str, value: Column, least: float, always: Column | None = None) -> DataFrame:
    """rows with the column name = value where it is over least, or where `always` holds."""
    return only(rows, name, value, lambda v: (v > least) if always is None else always | (v > least))


# the parse of a page

def sections(pages: DataFrame, keywords: list[str]) -> DataFrame:
    """Elements of the main part with at least ten words and a quick score over 0.2. Text of nested elements is scanned again at each level."""
    out = nodes(pages, main=True).where(has_words(F.col("text"), 10))
    return at_least(out, "quick_score", score.quick(F.col("text"), keywords), 0.2)


def top_sections(pages: DataFrame, keywords: list[str], many: int = 50) -> DataFrame:
    """A page's best sections, ties in the order of the markup."""
    rank = F.row_number().over(Window.partitionBy("page_id", "url").orderBy(F.desc("quick_score"), "node_id"))
    return sections(pages, keywords).withColumn("rank", rank).where(F.col("rank") <= many)


def relevant_sections(pages: DataFrame, q: Query, counter: Callable[[Column], Column] = sub_tokens) -> DataFrame:
    return at_least(top_sections(pages, q.keywords), "score", score.semantic(F.col("text"), q.keywords, q.entities, counter), 0.3)


def section_chunks(found: DataFrame, keywords: list[str], budget: int = 1000) -> DataFrame:
    """sections (page_id, url, rank, tag, text, attributes, score) as chunks with labels."""
    return _chunked(found, keywords, budget).select("page_id", "url", "rank", "part", *CHUNK)


CHUNK = ("content", "chunk_type", "tag", "score", "word_count", "chunk_id", "metadata")


def _chunked(found: DataFrame, keywords: list[str], budget: int, others: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, url, rank, part, the columns of a chunk, others): the chunks of each section; nulls for a row without text."""
    pieces = F.when(F.col("text").isNull(), F.array(F.lit(None).cast("string"))).otherwise(semantic_chunks(F.col("text"), budget))
    out = found.select("page_id", "url", "rank", "tag", "attributes", "score", *others, F.posexplode(pieces).alias("part", "content"))
    c, found = F.col("content"), F.col("_labels")
    out = only(out, "_labels", classify.labels(c, keywords))
    there = lambda v: F.when(c.isNotNull(), v)
    meta = F.struct(F.col("tag").alias("source_tag"), found["keywords_found"].alias("keywords_found"), "attributes", found["technical_indicators"].alias("technical_indicators"))
    return out.select("page_id", "url", "rank", "part", "content", there(found["chunk_type"]).alias("chunk_type"), "tag", "score", there(word_count(c)).alias("word_count"), content_id(c).alias("chunk_id"), there(meta).alias("metadata"), *others)


def parsed_documents(pages: DataFrame, q: Query, budget: int = 1000, counter: Callable[[Column], Column] = sub_tokens) -> DataFrame:
    """A row a page: metadata, chunks in order of their sections, their number, mean score, kinds and concepts. Pages without chunks have score 0."""
    # one parse a page: the head of a page is a row before its sections, and stays when they are filtered
    found = parsed(pages, ("title", "meta", "error", "main_nodes"))
    rows = found.select("page_id", "url", F.struct("title", "meta", "error").alias("head"), F.explode(F.concat(F.array(F.lit(None)), F.coalesce("main_nodes", F.array()))).alias("n"))
    rows = rows.select("page_id", "url", F.when(F.col("n").isNull(), F.col("head")).alias("head"), F.col("n.node_id"), F.col("n.tag"), F.col("n.text"), F.col("n.attributes"))
    text = F.col("text")
    is_head = F.col("head").isNotNull()
    rows = at_least(rows.where(is_head | has_words(text, 10)), "quick_score", F.when(~is_head, score.quick(text, q.keywords)), 0.2, is_head)
    rank = F.row_number().over(Window.partitionBy("page_id", "url").orderBy(is_head, F.desc("quick_score"), "node_id"))
    rows = at_least(rows.withColumn("rank", rank).where(is_head | (F.col("rank") <= 50)), "score", F.when(~is_head, score.semantic(text, q.keywords, q.entities, counter)), 0.3, is_head)
    chunks = _chunked(rows, q.keywords, budget, ("head",))
    out = chunks.groupBy("page_id", "url").agg(
        F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("rank", "part", F.struct(*CHUNK).alias("chunk")))), _by_place).alias("chunks"),
        F.avg("score").alias("relevance_score"),
        F.count("content").cast("int").alias("chunk_count"),
        F.array_sort(F.collect_set("chunk_type")).alias("content_types"),
        F.any_value("head", True).alias("head"),
    ).select("*", "head.*").withColumn("technical_concepts", F.array_sort(F.array_distinct(F.flatten(F.transform("chunks", lambda c: c["chunk"]["metadata"]["technical_indicators"])))))
    none = F.array().cast("array<string>")
    meta = F.struct(
        "url", "title", F.lit("web").alias("source_type"), F.unix_timestamp().cast("double").alias("crawl_time"), F.array(*map(F.lit, q.keywords)).cast("array<string>").alias("query_keywords"),
        F.col("meta")["description"].alias("description"), F.col("meta")["keywords"].alias("meta_keywords"), F.col("meta")["author"].alias("author"), F.col("meta")["date"].alias("date"), F.col("meta")["published"].alias("published"), "error",
    )
    return out.select(
        "page_id", "url", "title", F.coalesce("relevance_score", F.lit(0.0)).alias("relevance_score"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.coalesce("content_types", none).alias("content_types"), F.coalesce("technical_concepts", none).alias("technical_concepts"), meta.alias("metadata"), F.transform("chunks", lambda c: c["chunk"]).alias("chunks"),
    )


def _by_place(a: Column, b: Column) -> Column:
    less = (a["rank"] < b["rank"]) | ((a["rank"] == b["rank"]) & (a["part"] < b["part"]))
    same = (a["rank"] == b["rank"]) & (a["part"] == b["part"])
    return F.when(less, -1).when(same, 0).otherwise(1)


def final_documents(pages: DataFrame, q: Query, crawl_keywords: list[str], least: float = 0.2, technical: float = 0.3) -> DataFrame:
    """Parsed documents over least with the crawl's depth, if pages has one, and the technical chunks over technical; best first."""
    docs = parsed_documents(pages, q).where(F.col("relevance_score") > least)
    extra = article_chunks(pages, crawl_keywords).where(F.col("type").isin("code", "table") & (F.col("relevance") > technical))
    extra = extra.groupBy("page_id", "url").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "content", "type", "language", "relevance"))), lambda c: F.struct(c["id"].alias("id"), c["content"].alias("content"), c["type"].alias("type"), c["language"].alias("language"), c["relevance"].alias("relevance"))).alias("technical_content"))
    out = docs.join(extra, ["page_id", "url"], "left")
    if "depth" in pages.columns:
        out = out.join(pages.select("page_id", "url", F.struct("depth").alias("crawl_metadata")), ["page_id", "url"], "left")
    return out.orderBy(F.desc("relevance_score"), "url", "page_id")
