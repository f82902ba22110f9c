"""What the pipeline's stages have the driver hold: no broadcasts for joins of tables, no sample as one result, one copy of the sent words."""

import tracemalloc

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm import bpe, langid, near_copies
from prosegauge.llm.common import lookup


def _plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_of_small_tables_are_no_broadcasts(spark):
    rows, table = spark.range(50).selectExpr("id % 5 AS k", "id"), spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    found = lookup(rows, "k", table)
    assert sorted((r.id, r.v) for r in found.collect()) == [(i, {1: "a", 2: "b"}.get(i % 5)) for i in range(50)]
    sets = spark.createDataFrame([(i, near_copies.packed(near_copies.shingles(t))) for i, t in enumerate(["a b c d e f", "a b c d e f", "u v w x y z"])], "node long, own binary")
    alike = near_copies._verified(spark.createDataFrame([(0, 1), (0, 2)], "a long, b long"), sets, 0.8)
    assert [tuple(r) for r in alike.collect()] == [(0, 1)]
    assert "Broadcast" not in _plan(found) + _plan(alike)


def test_the_sample_comes_part_by_part(spark, monkeypatch):
    texts = {f"word number {i} of {'abc' * (i % 4)}": "en" if i % 2 else "fr" for i in range(60)}
    learn = spark.createDataFrame([*texts.items(), *texts.items()], "text string, lang string")
    idf = np.random.default_rng(1).random(langid.BUCKETS)
    of = {r.text: r.h for r in learn.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    with monkeypatch.context() as m:
        m.delattr(type(learn), "collect")
        got = langid.sample(learn, idf)
    assert [lang for lang, _, _ in got] == [texts[t] for t in sorted(of, key=of.get)]
    for (_, at, x), text in zip(got, sorted(of, key=of.get), strict=True):
        g = langid.grams(text)
        own, n = np.unique(g, return_counts=True)
        assert np.array_equal(at, own) and np.array_equal(x, langid.SCALE * n / max(1, len(g)) * idf[own])


def test_the_driver_holds_the_sent_words_once(spark, monkeypatch):
    monkeypatch.setattr(bpe, "PART_BYTES", 1 << 19, raising=False)
    table = spark.range(300_000).selectExpr("concat('w', id) AS word", "id % 7 + 1 AS n", "unhex(lpad(hex(id), 16, '0')) AS ids").repartition(16)
    bpe._head(table, "<u2", 1 << 30)  # what is imported and kept is there now
    tracemalloc.start()
    head = bpe._head(table, "<u2", 1 << 30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    own = head.hashes.nbytes + head.starts.nbytes + head.ids.nbytes
    assert head.whole and len(head.hashes) == 300_000 and (np.diff(head.hashes) > 0).all() and (np.diff(head.starts) == 4).all()
    assert peak < 1.6 * own
