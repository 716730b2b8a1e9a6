"""What the corpus operators share: stored intermediate tables, ranks, components, byte and word views of Arrow text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and the session is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/weblode-shared"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables stored in the shared folder. They cut lineage and survive a lost executor; each is deleted by drop(), by the end of released(), or when the driver ends."""

    live: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))
        Scratch.live.append(self)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it again; the shuffle files that it took are deleted as soon as it is written."""
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)

    @staticmethod
    @contextmanager
    def released() -> Iterator[None]:
        """Delete at the end what was stored within; only for code that has written its result elsewhere by then."""
        before = len(Scratch.live)
        try:
            yield
        finally:
            for s in Scratch.live[before:]:
                s._fs.delete(s._path(s.root), True)
            del Scratch.live[before:]


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Within, the batches that workers get hold about size bytes at most, unless a single row does; for plans that run within."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_keys(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a whole text: XXH64 under two seeds; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return F.xxhash64(whole).alias("h1"), F.xxhash64(F.lit(1), whole).alias("h2")


def distinct_texts(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """Stored rows (tid, h1, h2, body, least, copies): each different text once, with its least doc_id and number of rows.

    Copies meet in a sort-based aggregate with a map-side part, so a text that a third of all rows carry is one row per task before the shuffle.
    """
    h1, h2 = text_keys(F.col("text"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"), h1, h2)
    merged = rows.groupBy("h1", "h2").agg(F.any_value("body").alias("body"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    return scratch.store(merged.select(F.monotonically_increasing_id().alias("tid"), "h1", "h2", "body", "least", "copies"), "texts")


def ranked(scratch: Scratch, df: DataFrame, group: list[str], order: list[Column], name: str, weight: str | None = None) -> DataFrame:
    """Add place (1, 2, ... within the group) and, with weight, upto (sum of the weights up to and with the row).

    A range partition by group and order spreads one group over many tasks. The parts are stored, so that their row numbers can't change
    between the two passes; only one row per part and group meets in the table of offsets.
    """
    keys = [F.col(g) for g in group]
    parts = scratch.store(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), name)
    total = [F.count(F.lit(1)).alias("_n")] + ([F.sum(weight).alias("_w")] if weight else [])
    sums = parts.groupBy("_part", *keys).agg(*total)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g_{g}") for g in group], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *([F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w0")] if weight else []))
    joined = parts.join(offsets, (parts["_part"] == offsets["_p"]) & _all([parts[g].eqNullSafe(offsets[f"_g_{g}"]) for g in group]), "left")
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = joined.withColumn("place", F.row_number().over(inside) + F.col("_n0"))
    if weight:
        out = out.withColumn("upto", F.sum(weight).over(upto) + F.col("_w0"))
    return out.drop("_part", "_p", "_n0", "_w0", *[f"_g_{g}" for g in group])


def _all(conditions: list[Column]) -> Column:
    found = F.lit(True)
    for c in conditions:
        found = found & c
    return found


def components(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node reachable. Distributed union-find by alternating large and small stars.

    Each round hangs every neighbour on the least node known beside it; minima are combined map-side and the join back is one AQE can split,
    so a node with a third of all edges is no single task. Rounds stop when a round changes no edge; each is stored in the shared folder.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    current, seen, k = scratch.store(pairs, f"{name}0"), None, 0
    while True:
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen, k = mark, k + 1
        both = current.select(F.col("u").alias("n"), F.col("v").alias("o")).unionByName(current.select(F.col("v").alias("n"), F.col("u").alias("o")))
        least = both.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.join(least, "n").where("o > n").select(F.col("o").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        small = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        current = scratch.store(small, f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the components of the links (a, b): each node to the least of its component."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = both[: len(a)], both[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        np.minimum.at(root, u, before[v])
        np.minimum.at(root, v, before[u])
        root = root[root]
        if (root == before).all():
            break
    off = root != np.arange(len(nodes))
    return nodes[off], nodes[root[off]]


def numbered(scratch: Scratch, docs: DataFrame, name: str = "numbered") -> DataFrame:
    """Stored rows (rid, doc): a number for each row of docs, by which slim results find it again, and its columns as one struct, so that no name clashes."""
    whole = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])
    return scratch.store(docs.select(F.monotonically_increasing_id().alias("rid"), whole.alias("doc")), name)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one array, and the offsets of its rows (one more than rows); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]] if len(at) else body[:0], at - (at[0] if len(at) else 0)


def blank(body: np.ndarray) -> np.ndarray:
    """Where a byte is one of \\x20 and \\x09-\\x0D."""
    return (body == 32) | ((body >= 9) & (body <= 13))


_R, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept per process and grown by doubling."""
    key = (base, 0)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.ones(1, np.uint64)
            while len(have) < size:
                have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _POWERS[key] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit symbols, from prefix sums of symbol * base ** place modulo 2 ** 64."""

    def __init__(self, symbols: np.ndarray, base: int = _Q) -> None:
        n = len(symbols)
        self.inverse = powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(symbols * powers(base, n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def words_of(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte places) of the words of all rows, and the offset of each row's first word (one more than rows).

    A word is a longest run of bytes that aren't blank, within one row.
    """
    full = ~blank(body)
    left = np.ones(len(body) + 1, bool)
    left[1:] = ~full
    edges = at[(at >= 0) & (at <= len(body))]
    left[edges] = True
    starts = np.flatnonzero(full & left[:-1])
    right = np.ones(len(body) + 1, bool)
    right[:-1] = ~full
    right[edges] = True
    ends = np.flatnonzero(full & right[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the leftmost place of the least of values[i : i + width]; windows reaching past the end see what is there."""
    n = len(values)
    best, place, have = values.copy(), np.arange(n, dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        if step >= n:
            break
        lower = best[step:] < best[:-step]
        best[:-step] = np.where(lower, best[step:], best[:-step])
        place[:-step] = np.where(lower, place[step:], place[:-step])
        have += step
    return place


def batches(frames: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that none holds more than about limit bytes, unless a single row does."""
    for b in frames:
        if b.num_rows == 0:
            continue
        sizes = np.maximum(1, b.nbytes // b.num_rows)
        step = max(1, int(limit // sizes))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)
