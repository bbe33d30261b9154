"""The pipeline's stages against brute force on a small table."""

import os
import zlib
from collections import Counter

import pytest
from pyspark.sql import SparkSession

import corpus_pipeline
from strataseek.llm import simhash


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        after.write.parquet(path)
        before = spark.read.parquet(path)
        kept.append({r.doc_id: r.text for r in before.collect()})
    assert docs.count() > len(kept[0]) >= len(kept[1]) > len(kept[2]) > 0
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = kept[0]
    good = [k for k, q in labels.items() if q == 1]
    assert len([k for k in kept[1] if labels.get(k) == 1]) >= 0.97 * len([k for k in got if labels.get(k) == 1])
    assert sum(k in got for k in good) >= 0.85 * len(good)
    # one document of each near-duplicate group is left, the one with the smallest id
    fps = {k: simhash.fingerprint(t) for k, t in kept[1].items()}
    left = sorted(kept[2])
    assert all((fps[a] ^ fps[b]).bit_count() > 2 for i, a in enumerate(left) for b in left[:i])
    reach = set(left)
    grew = True
    while grew:
        more = {k for k in fps if k not in reach and any((fps[k] ^ fps[r]).bit_count() <= 2 for r in reach)}
        reach |= more
        grew = bool(more)
    assert reach == set(fps)
    packed = corpus_pipeline.packing_stage(spark, before, sf).collect()
    assert {r.doc_id for r in packed} == set(left)
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and sum(used.values()) / (2048 * len(used)) > 0.9


def test_run(spark, tiny):
    assert corpus_pipeline.run(spark, tiny).count() > 0


def test_near_duplicates_without_own_ids(spark, tiny):
    one, two = "one text of some words that is here again and again", "quite another line about ships and the sea in winter"
    rows = [(7, one), (7, one), (None, one), (3, one), (None, two), (None, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.near_duplicate_stage(spark, docs, tiny)
    assert left.columns == docs.columns
    assert sorted((r.text, r.doc_id) for r in left.collect()) == [(one, 3), (two, None)]


def test_packing_stage_gives_ids(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(20)
    packed = corpus_pipeline.packing_stage(spark, docs, tiny).collect()
    assert packed and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in packed)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, tiny, name, stage):
    """Nulls in each column, empty and very long texts, ties, repeats, clashing names; no rows."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(30)
    long = " ".join(f"word{i % 700} and the" for i in range(60_000))
    odd = [(None, None, None, None, None), (5_000, "", "en", "s", 0), (5_001, long, None, "s", len(long)), (5_001, long, None, "s", len(long)), (5_002, "x" * 300_000, "en", None, 300_000), (None, "one two " * 40, "en", "s", 3)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    clash = docs.selectExpr("*", "1 as DOC_ID", "2 as n_words", "3 as kept", "4 as _kept_id", "5 as fp", "6 as row", "7 as _c0", "8 as task", "9 as l2", "0 as lang_pred", "text as TEXT")
    for table in (docs, clash):
        out = stage(spark, table, tiny)
        assert out.count() > 0 and stage(spark, table.limit(0), tiny).count() == 0
        if name != "packing":
            assert out.columns == table.columns
    if name == "near_duplicates":
        assert stage(spark, docs, tiny).where("doc_id = 5001").count() == 1


def test_run_leaves_its_result_alone(spark, tiny):
    found = corpus_pipeline.run(spark, tiny).inputFiles()
    folder = found[0].rsplit("/", 2)[0].removeprefix("file://")
    assert [x for x in os.listdir(folder) if x.startswith("pipeline-") and x.split("-")[1] != "packing"] == []


def test_quality_adapts():
    """Two sources with other habits have other cutoffs, which no one fixed cutoff can match."""
    from strataseek.llm import quality

    spark = SparkSession.getActiveSession()
    words = lambda n, size: " ".join("abcdefghijkl"[i % 12] * size + str(i) for i in range(n))
    rows = [(i, words(60 + i % 7, 3 + i % 2), "en", "chat") for i in range(300)] + [(1000 + i, words(60 + i % 7, 20 + i % 5), "en", "law") for i in range(300)]
    # usual in one source and out of place in the other
    rows += [(5000, words(60, 21), "en", "chat"), (5001, words(60, 21), "en", "law")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got.values()) == len(rows) - 1 and not got[5000] and got[5001]
