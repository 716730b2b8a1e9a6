"""SimHash near-duplicates, found by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most 2 * half bits have a common variant with at most half bits flipped in each. Every different
fingerprint emits all such variants (2,081 for half = 2); variants are shuffled, and those that meet are verified. Exact copies share a
fingerprint and emit once.

What is shuffled are blobs of 3-byte keys, not rows: a key is 24 bits of a linear hash of the variant, next to the partition number that other
bits of that hash give. The number of partitions follows the count of fingerprints, so that a partition holds about 2 ** 23 variants at any
size. A blob carries the fingerprints that have a key in it and no others, each once with the number of its keys, so a variant never takes more than 13
bytes and what is shuffled grows with the number of fingerprints. Keys that meet by chance fail the Hamming check. In a meeting of two to eight fingerprints all pairs are verified; in a larger one the
full variants are made again, and those that really are equal (hence all within the radius of each other) are linked to their least. A partition
passes on a spanning forest of its links, so a group of g near copies gives at most g rows a partition, never all pairs, and no component is torn.

Defined results. Null text: as empty. Very long texts: the words and shingle hashes of one text are held at a time, 8 bytes a word. Empty or blank text: no words, fingerprint zero, linked like any other. Fewer words than the shingle: the
whole sequence is one shingle. Repeated rows: all kept, same fingerprint. Null doc_id: the row keeps a fingerprint and a component; the least
doc_id ignores nulls, so a component without any doc_id has null. Empty table: no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.llm.common import Scratch, batches, components, forest, numbered, table

SEED = 42
#: Fingerprints whose variants are made at once, and those of one blob.
SLICE, CHUNK = 512, 2048
KEY_BITS = 24


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, n = b" ".join(words), len(words) - shingle + 1
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    h, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    for k in range(0, n, 65536):
        part = hashes[k : k + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            found = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def flips(half: int) -> np.ndarray:
    """All masks of at most half set bits."""
    masks = [sum(1 << b for b in chosen) for k in range(half + 1) for chosen in combinations(range(64), k)]
    return np.array(masks, np.uint64)


class Linear:
    """An invertible linear map of 64-bit vectors over GF(2): the hash of a variant is the hash of the fingerprint XOR that of the mask."""

    def __init__(self) -> None:
        rng = np.random.default_rng(7)
        while True:
            columns = rng.integers(0, 1 << 64, 64, dtype=np.uint64)
            if self._rank([int(c) for c in columns]) == 64:
                break
        self.tables = np.zeros((8, 256), np.uint64)
        for k in range(8):
            for byte in range(256):
                for bit in range(8):
                    if byte >> bit & 1:
                        self.tables[k, byte] ^= columns[8 * k + bit]

    @staticmethod
    def _rank(rows: list[int]) -> int:
        rank = 0
        while rows:
            top = max(rows)
            rows.remove(top)
            if not top:
                break
            rank += 1
            high = top.bit_length()
            rows = [r ^ top if r.bit_length() == high else r for r in rows]
        return rank

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.uint64)
        for k in range(8):
            out ^= self.tables[k][(x >> np.uint64(8 * k)) & np.uint64(255)]
        return out


def _place(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition (the top bits of the hash) and key (the next 24)."""
    part = (h >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32) if bits else np.zeros(h.shape, np.uint16)
    return part, ((h >> np.uint64(64 - bits - KEY_BITS)) & np.uint64((1 << KEY_BITS) - 1)).astype(np.uint32)


def emitter(half: int, bits: int):
    """Arrow batches of (fp) to blobs (part, fps, counts, keys): keys in the order of fps, counts[i] of them from fps[i], all of which have some."""

    def blobs(fps: np.ndarray, masks: np.ndarray, linear: Linear) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        parts, keys = [], []
        for k in range(0, len(fps), SLICE):
            part, key = _place((linear(fps[k : k + SLICE])[:, None] ^ masks[None, :]).ravel(), bits)
            parts.append(part)
            keys.append(key)
        part, key = np.concatenate(parts), np.concatenate(keys)
        order = np.argsort(part, kind="stable")
        part, owner = part[order], (order // len(masks)).astype(np.int32)
        packed = key[order].view(np.uint8).reshape(-1, 4)[:, :3]
        first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])]))
        counts, heads, of = np.diff(np.append(first, len(part))).astype(np.uint16), fps[owner[first]], part[first]
        edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
        starts = np.append(first, len(part))[edges]
        for k, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            yield int(of[x]), heads[x:y].tobytes(), counts[x:y].tobytes(), packed[starts[k] : starts[k + 1]].tobytes()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linear = Linear()
        masks = linear(flips(half))
        held: list[np.ndarray] = []

        def flush(fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            rows = list(blobs(fps, masks, linear))
            for k in range(0, len(rows), 16):
                part = rows[k : k + 16]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), *(pa.array([r[j] for r in part], pa.binary()) for j in (1, 2, 3))], ["part", "fps", "counts", "keys"])

        for b in frames:
            held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            while sum(map(len, held)) >= CHUNK:
                whole = np.concatenate(held)
                held = [whole[CHUNK:]]
                yield from flush(whole[:CHUNK])
        rest = np.concatenate(held) if held else np.zeros(0, np.uint64)
        if len(rest):
            yield from flush(rest)

    return run


def _meetings(fps: np.ndarray, met: np.ndarray, part: int, bits: int, half: int) -> np.ndarray:
    """Verified links (rows of two fingerprints) of one partition; met: key << 32 | row in fps, sorted here in place."""
    met.sort()
    view = met.view(np.uint32).reshape(-1, 2)
    w, k = view[:, 0], view[:, 1]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.concatenate([first, [len(k)]]))
    pairs = []
    for lag in range(1, 8):
        a = np.flatnonzero((k[lag:] == k[:-lag])) if lag == 1 else a[(a + lag < len(k))]
        if lag > 1:
            a = a[k[a + lag] == k[a]]
        if not len(a):
            break
        pairs.append(np.stack([w[a], w[a + lag]], 1).astype(np.int64))
    links = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    links = links[np.bitwise_count(fps[links[:, 0]] ^ fps[links[:, 1]]) <= 2 * half]
    found = [fps[links]]
    large = np.flatnonzero(size > 8)
    if len(large):
        linear, wanted = Linear(), k[first[large]]
        masks = linear(flips(half))
        members = np.unique(np.concatenate([w[first[g] : first[g] + size[g]] for g in large])).astype(np.int64)
        at, made = [], []
        for j in range(0, len(members), SLICE):
            some = members[j : j + SLICE]
            h = linear(fps[some])[:, None] ^ masks[None, :]
            p, kk = _place(h, bits)
            hit = (p == part) & np.isin(kk, wanted)
            made.append(h[hit])
            at.append(np.broadcast_to(fps[some][:, None], h.shape)[hit])
        made, at = np.concatenate(made), np.concatenate(at)
        by = np.lexsort((at, made))
        made, at = made[by], at[by]
        start = np.concatenate([[True], made[1:] != made[:-1]])
        found.append(np.stack([at, at[np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))]], 1))
    links = np.concatenate(found)
    links = np.stack([links.max(axis=1), links.min(axis=1)], 1)
    return np.unique(links[links[:, 0] != links[:, 1]], axis=0)


def meeter(half: int, bits: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        fps, n, at = [], 0, 0
        met = np.zeros(sum(map(len, group["keys"])) // 3, np.uint64)
        for head, counts, blob in zip(group["fps"], group["counts"], group["keys"], strict=True):
            f = np.frombuffer(head, np.uint64)
            raw = met[at : at + len(blob) // 3].view(np.uint8).reshape(-1, 8)
            raw[:, 4:7] = np.frombuffer(blob, np.uint8).reshape(-1, 3)
            raw.view(np.uint32)[:, 0] = np.repeat(np.arange(n, n + len(f), dtype=np.uint32), np.frombuffer(counts, np.uint16))
            fps.append(f)
            n, at = n + len(f), at + len(blob) // 3
        links = _meetings(np.concatenate(fps), met, int(key[0]), bits, half)
        a, b = forest(links[:, 0], links[:, 1])
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def links(fps: DataFrame, count: int, half: int = 2, bits: int | None = None) -> DataFrame:
    """(a, b): pairs of the different fingerprints fps (fp) whose components are those of all links within 2 * half bits. bits: of the partition number, else by count."""
    each = sum(1 for _ in flips(half))
    bits = max(0, (max(1, count * each) - 1).bit_length() - 23) if bits is None else bits
    spread = max(1, min(count // CHUNK, 1 << 16))
    blobs = fps.select("fp").repartition(spread, "fp").mapInArrow(emitter(half, bits), "part int, fps binary, counts binary, keys binary")
    return blobs.repartition(1 << bits, "part").groupBy("part").applyInPandas(meeter(half, bits), "a long, b long").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs (doc_id, text); radius must be even."""
    scratch = Scratch(spark, "simhash")
    rows = scratch.store(fingerprints(docs, shingle), "rows")
    each = scratch.store(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "each")
    found = links(each, each.count(), radius // 2)
    roots = components(scratch, scratch.store(found, "links"))
    named = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def distinct_documents(spark: SparkSession, docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """docs with one document of each component: that with the least doc_id (the first such row, if it is repeated; one without doc_id only if none has any)."""
    rows = numbered(Scratch(spark, "distinct"), docs)
    found = near_duplicates(spark, rows.select(F.col("rid").alias("doc_id"), F.col("doc.text").alias("text")), shingle, radius).select(F.col("doc_id").alias("rid"), "component_id")
    stays = found.join(rows.select("rid", F.col("doc.doc_id").alias("doc_id")), "rid").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first"))
    return rows.join(stays.select(F.col("first.rid").alias("rid")), "rid", "left_semi").select("doc.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op6_simhash": op6_simhash}
ORACLE_SQL: dict[str, str] = {}
