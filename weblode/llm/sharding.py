"""Sharding by a k-d tree over metadata: leaves of equal bytes.

A node is split at the weighted median of its widest dimension, the weight being bytes, until its leaves reach the target size. All nodes of
a level are split in one pass: each takes its widest dimension (range within the node over range in the whole table), rows are put in order by
(node, value, hash) with a distributed rank that carries running bytes, and the cut is where the running bytes pass the node's share. So a cut is
off by one row at most, ties in a dimension are broken by hash, and a hot value or source is split like any other.

Equal texts are one point of the tree with the sum of their bytes, so a group of copies has one shard, whatever its size. A cut is off by one point at
most: by a group's bytes, where the group is large. Only a group of more bytes than a whole shard should have can't keep the law, sizes near equal; its rows
are points of their own, and it takes up several shards. There are at most as many such groups as shards.

Dimensions: size, language, source and doc_id, each mapped to a number: size to its logarithm, language and source to their rank among the values by code point.

Defined results. Null text: size 1 and checksum 0, as for an empty one. Null metadata: value -1. Repeated rows: each gets its own slot; which of
two rows with equal text and doc_id has which of their slots is open. Very long texts: only their length and hashes are read. Empty table: no rows. Fewer groups
than shards: some shards are empty. shard() keeps other columns, whatever their names; shard and slot are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weblode.llm.common import Scratch, numbered, ranked, table, text_keys

SHARDS = 8
DIMENSIONS = ("d_size", "d_lang", "d_source", "d_id")


def _coded(docs: DataFrame, column: str) -> DataFrame:
    """docs with d_<column>: the rank of its value by code point, -1 for null. The values are few beside the rows and are joined, not collected."""
    values = docs.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows")).where("value is not null")
    codes = values.select(F.col("value").alias("_value"), F.percent_rank().over(Window.orderBy(F.col("value").cast("binary"))).alias(f"d_{column}"))
    return docs.join(codes, docs[column].cast("string") == codes["_value"], "left").withColumn(f"d_{column}", F.coalesce(f"d_{column}", F.lit(-1.0))).drop("_value")


def described(docs: DataFrame, *others: Column) -> DataFrame:
    """(doc_id, size, text_crc32, h1, h2, the dimensions, and others) of each row of docs (doc_id, text, lang, source)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    slim = docs.select(
        "doc_id",
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *text_keys(F.col("text")),
        F.log2(size.cast("double")).alias("d_size"),
        F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0)).alias("d_id"),
        "lang",
        "source",
        *others,
    )
    return _coded(_coded(slim, "lang"), "source").drop("lang", "source")


def kd_shards(spark: SparkSession, rows: DataFrame, shards: int, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """described rows with shard (0 .. shards - 1) and slot (0, 1, ... within the shard)."""
    scratch = Scratch(spark, "sharding")
    rows = scratch.store(rows, "rows")
    limit = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    groups = scratch.store(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("least"), *[F.min(c).alias(c) for c in dimensions]), "groups")
    one = groups.where(F.col("bytes") <= limit).select(F.col("bytes").alias("size"), F.col("least").alias("doc_id"), "h1", "h2", *dimensions)
    large = groups.where(F.col("bytes") > limit).select("h1", "h2")
    # each of these groups has more than 1 / shards of all bytes, so there are fewer than shards of them
    rest = rows.join(F.broadcast(large), ["h1", "h2"])
    names = [c for c in rows.columns if c not in ("size", "doc_id", "h1", "h2", *dimensions)]
    points = one.select("*", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names], F.lit(True).alias("whole")).unionByName(rest.withColumn("whole", F.lit(False)))
    found = _leaves(scratch, points.withColumn("tie", F.xxhash64("h1", "doc_id")), shards, dimensions).drop("leaves", "tie")
    placed = rows.join(found.where("whole").select("h1", "h2", "node"), ["h1", "h2"]).unionByName(found.where("not whole").drop("whole"))
    placed = ranked(scratch, placed, ["node"], [F.col("h1"), F.col("h2"), F.col("doc_id")], "slots")
    return placed.withColumn("shard", F.col("node").cast("int")).withColumn("slot", (F.col("place") - 1).cast("long")).drop("node", "place", "h1", "h2", *dimensions)


def _leaves(scratch: Scratch, rows: DataFrame, shards: int, dimensions: tuple[str, ...]) -> DataFrame:
    """rows (size, tie, dimensions, doc_id) with node, the leaf of each."""
    rows = scratch.store(rows.withColumn("node", F.lit(0)).withColumn("leaves", F.lit(shards)), "level0")
    width = lambda c: F.max(c) - F.min(c)
    overall = rows.agg(*[width(c).alias(c) for c in dimensions]).first()
    level, most = 0, shards
    while most > 1:
        spans = F.array(*[F.struct((width(c) / F.lit(float(overall[c] or 1.0))).alias("span"), F.lit(-k).alias("k")) for k, c in enumerate(dimensions)])
        nodes = rows.groupBy("node").agg((-F.array_max(spans)["k"]).alias("dim"), F.sum("size").alias("bytes")).withColumnRenamed("node", "_node")
        # one row a node, and there are fewer nodes than shards
        joined = rows.join(F.broadcast(nodes), rows["node"] == F.col("_node")).drop("_node")
        value = F.element_at(F.array(*[F.col(c) for c in dimensions]), F.col("dim") + 1)
        placed = ranked(scratch, joined.withColumn("_value", value), ["node"], [F.col("_value"), F.col("tie"), F.col("doc_id")], f"ranked{level}", weight="size")
        left = F.floor((F.col("leaves") + 1) / 2).cast("int")
        first = (F.col("upto") - F.col("size") / 2) * F.col("leaves") <= F.col("bytes") * left
        split = F.col("leaves") > 1
        node = F.when(split & ~first, F.col("node") + left).otherwise(F.col("node"))
        leaves = F.when(~split, F.col("leaves")).when(first, left).otherwise(F.col("leaves") - left)
        level += 1
        rows = scratch.store(placed.withColumn("_n", node).withColumn("leaves", leaves).withColumn("node", F.col("_n")).drop("_n", "dim", "bytes", "_value", "place", "upto"), f"level{level}")
        scratch.drop(f"level{level - 1}", f"ranked{level - 1}")
        most = (most + 1) // 2
    return rows


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs (doc_id, text, lang, source and any others) with shard and slot; columns of these names are replaced."""
    rows = numbered(Scratch(spark, "shard"), docs.drop("shard", "slot"))
    slim = described(rows.select("rid", "doc.doc_id", "doc.text", "doc.lang", "doc.source"), F.col("rid"))
    return rows.join(kd_shards(spark, slim, shards).select("rid", "shard", "slot"), "rid").select("doc.*", "shard", "slot")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(spark, described(table(spark, sf_dir, "documents")), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_sharding": op9_sharding}
ORACLE_SQL: dict[str, str] = {}
