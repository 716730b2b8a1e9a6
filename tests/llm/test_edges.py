"""What every corpus operator must bear: other orders of the rows, clashing columns, very long texts, and the pipeline from end to end."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, corpus, prose, words_of
from weblode.llm import bytespans, common, decontaminate, licences, lines, mixing, passages, sharding, simhash, toxicity

CLASHING = ("_rid", "rid", "doc", "_copies", "copies", "copy", "tie", "place", "size", "node", "shard", "h1", "h2", "fp", "root", "body", "at", "score", "share", "item_ids", "ids", "_part", "_value", "component_id", "_source", "n")


@pytest.fixture(scope="module")
def clashing(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    return docs.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce("doc_id", F.lit(-1)).cast("string")).alias(c) for c in CLASHING])


def holds(out, whole=True):
    """Each row still has its own values in the columns of the caller."""
    for r in out:
        i = -1 if r["doc_id"] is None else r["doc_id"]
        assert all(r[c] == f"{c}-{i}" for c in CLASHING if whole or c != "shard")


def test_operators_that_keep_documents_keep_clashing_columns(spark, clashing):
    bench = spark.createDataFrame([(1, corpus()[50][1]), (2, None)], "item_id long, text string")
    for found in (simhash.distinct_documents(spark, clashing), decontaminate.clean(spark, clashing, bench), mixing.mix(spark, clashing)):
        rows = found.collect()
        assert found.columns == clashing.columns and rows
        holds(rows)
    found = sharding.shard(spark, clashing, 3)
    holds(found.collect(), False)
    assert found.count() == clashing.count()
    kept = toxicity.civil(clashing, spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(40)], "doc_id long, quality int, toxic int"))
    assert kept.columns == clashing.columns
    holds(kept.collect())


def test_operators_that_read_two_columns_ignore_clashing_ones(spark, clashing):
    plain = clashing.select("doc_id", "text")
    for run in (bytespans.repeated_bytes, passages.repeated_words, simhash.near_duplicates, lines.line_components):
        if run is lines.line_components:
            run = lambda s, d: lines.line_components(s, d).drop("row")
        plain_rows, rows = (sorted(map(str, run(spark, d).collect())) for d in (plain, clashing))
        assert rows == plain_rows and rows
    assert {r["doc_id"] for r in licences.scanned(clashing).collect()} == {r["doc_id"] for r in plain.collect()}


def test_mixing_gives_the_same_rows_in_another_order(spark):
    rng = random.Random(7)
    rows = [(None, f"{prose(rng, 9)} {k}", None, "s1", k) for k in range(60)] + [(k // 2, f"{prose(rng, 9)} {k}", None, None, k) for k in range(40)]
    rows += rows[:5]
    found = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        found.append(sorted(r["text"] for r in mixing.mix(spark, spark.createDataFrame(rows, SCHEMA).repartition(seed + 1)).collect()))
    assert found[0] == found[1] and len(found[0]) > 50


def test_sharding_gives_the_same_shards_in_another_order(spark):
    rows, found = corpus(), []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        out = sharding.kd_shards(spark, sharding.described(spark.createDataFrame(rows, SCHEMA)), 8).collect()
        found.append(sorted((str(r["doc_id"]), r["text_crc32"], r["shard"]) for r in out))
    assert found[0] == found[1]


@pytest.fixture(scope="module")
def long_texts():
    """Texts of over 3 MB, over every piece size, with repeats far apart, in one text and in two."""
    rng = random.Random(11)
    a = "".join(rng.choice("abcdefgh ") for _ in range(3_300_000))
    passage = prose(rng, 120)
    return [(1, f"{a[:2_200_000]} {passage} {a[2_200_000:]} {passage}"), (2, f"{passage} {a[:900]}"), (3, "short text")]


def test_very_long_texts(spark, long_texts):
    docs = spark.createDataFrame(long_texts, "doc_id long, text string")
    count = {}
    for _, t in long_texts:
        raw = t.encode()
        for k in range(len(raw) - 199):
            h = hash(raw[k : k + 200])
            count[h] = count.get(h, 0) + 1
    want = []
    for i, t in long_texts:
        raw = t.encode()
        hit = np.zeros(len(raw) + 1, np.int64)
        for k in range(len(raw) - 199):
            if count[hash(raw[k : k + 200])] > 1:
                hit[k] += 1
                hit[k + 200] -= 1
        stay = np.cumsum(hit[:-1]) == 0
        want.append((i, len(raw), int((~stay).sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[stay])).hexdigest()))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in bytespans.repeated_bytes(spark, docs).collect()]
    assert sorted(got) == want and want[0][2] > 0
    firsts = {}
    for i, t in long_texts:
        w = words_of(t)
        for k in range(len(w) - 49):
            firsts.setdefault(hash(tuple(w[k : k + 50])), i)
    removed = {}
    for i, t in long_texts:
        w = words_of(t)
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 49):
            if firsts[hash(tuple(w[k : k + 50]))] < i:
                gone[k : k + 50] = True
        removed[i] = (len(w), int(gone.sum()))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in passages.repeated_words(spark, docs).collect()} == removed
    assert removed[2][1] >= 120
    assert {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(spark, docs).collect()} == {i: f"{simhash.fingerprint(t):016x}" for i, t in long_texts}
    assert {r["doc_id"]: r["size"] for r in mixing.mixed(spark, mixing.sized(docs.withColumn("source", F.lit("s")))).collect()} == {i: len(words_of(t)) for i, t in long_texts}
    bench = spark.createDataFrame([(5, " ".join(long_texts[1][1].split()[10:60]))], "item_id long, text string")
    kept, found = decontaminate.leaks(spark, docs.unionByName(spark.createDataFrame([(k, f"other words {k}") for k in range(10, 20)], docs.schema)), bench)
    assert sorted(r[0] for r in found.join(kept, "rid").select("doc.doc_id").collect()) == [1, 2]
    assert sharding.shard(spark, docs.select("*", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source")), 2).count() == 3


def test_shared_folder_is_asked_for_on_a_cluster():
    class Conf:
        def get(self, key, other=None):
            return "spark://somewhere:7077" if key == "spark.master" else other

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def written(spark, folder, docs, labels, bench):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline(spark, tmp_path):
    rng = random.Random(21)
    item = prose(rng, 30)
    docs, labels = [], []
    for k in range(240):
        words = prose(rng, rng.randint(30, 120)).split()
        if k % 6 == 0:
            words[rng.randrange(len(words))] = rng.choice(["stupidface", "worthless", "idiotic"])
        docs.append((k, " ".join(words) + ".", "en", f"s{k % 4}" if k % 9 else None, 1))
        labels.append((k, 1, int(k % 6 == 0)))
    docs += [(300, docs[1][1], "de", "s1", 1), (301, docs[1][1] + " end", None, None, None), (302, f"{prose(rng, 20)} {item} {prose(rng, 20)}", "en", "s2", 1), (303, None, None, None, None), (304, "", "en", "s1", 0), (None, docs[3][1], "en", "s1", 1), docs[7], docs[7]]
    labels += [(None, 1, 1), (7, None, None)]
    folder = written(spark, tmp_path / "in", docs, labels, [(1, item), (2, None), (3, "")])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontaminate", "mix", "shard"]
    now, steps = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, folder).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        steps.append([tuple(r) for r in now.collect()])
        assert now.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    civil, distinct, clean, mix, shards = steps
    toxic = {k for k in range(240) if k % 6 == 0}
    assert not toxic & {r[0] for r in civil} and len(civil) >= len(docs) - len(toxic) - 4
    assert len({r[1] for r in distinct}) == len(distinct) and {1, 3, 7} <= {r[0] for r in distinct}
    fps = [simhash.fingerprint(r[1]) for r in distinct]
    assert all((a ^ b).bit_count() > 4 for k, a in enumerate(fps) for b in fps[:k])
    assert {r[0] for r in distinct} - {r[0] for r in clean} == {302}
    assert set(mix) <= set(clean) and max(mix.count(r) for r in set(mix)) <= 2
    assert sorted(map(str, (r[:5] for r in shards))) == sorted(map(str, mix)) and {r[5] for r in shards} == set(range(8))
    assert sorted(map(str, (r[:6] for r in shards))) == sorted(str(tuple(r)[:6]) for r in corpus_pipeline.run(spark, folder).collect())


def test_pipeline_on_empty_tables(spark, tmp_path):
    folder = written(spark, tmp_path / "in", [], [], [])
    out = corpus_pipeline.run(spark, folder)
    assert out.count() == 0 and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
