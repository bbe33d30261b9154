"""Every query with SQL against DuckDB, the others against what defines them."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracle import connect, difference
from strataseek.functions import chunker
from strataseek.plans import catalog, upkeep  # noqa: F401


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, con, tiny, name):
    assert difference(spark, con, tiny, catalog.QUERIES[name], catalog.SQL[name]) is None


def test_without_sql(spark, tiny):
    rest = {n: catalog.QUERIES[n](spark, tiny) for n in catalog.QUERIES if n not in catalog.SQL}
    assert set(rest) == {"bm25_stemmed", "chunk_split", "local_embed"}
    assert rest["bm25_stemmed"].count() > 0
    norms = rest["local_embed"].select(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-5 for r in norms)
    texts = {r.id: r.content for r in catalog.memories(spark, tiny).where("status = 'active'").collect()}
    got = {}
    for r in rest["chunk_split"].collect():
        got.setdefault(r.id, []).append((r.chunk_index, r.text, r.start, r.end))
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == {k: c for k, t in texts.items() if (c := chunker.split(t))}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
