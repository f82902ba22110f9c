"""Runs of sentences as rows against the finders of one text."""

import random

import pytest

from pyspark.sql import functions as F

from prosegauge import queries
from prosegauge.functions import finders
from prosegauge.operators.catalog import ALL
from prosegauge.operators.runs import RUNS, all_runs, long_texts, run_rows

PARTS = ["Now", "Bold", "no", "the", "Dr", "J", "perhaps", "we went to the mill", "she went to the barn", "a b c d e", "12", "'’-", "x" * 45, "y " * 220, "😀", "İ", "K", "é"]
GAPS = [". ", "! ", "?", "...", ".\n", "\n", "\n\n", "  ", " ", "?! ", ".    ", " ", " .", ". ", ". ", "."]


def texts(n: int, most: int = 40) -> list[str]:
    rng = random.Random(7)
    return ["".join(rng.choice(PARTS[: rng.randint(2, len(PARTS))]) + rng.choice(GAPS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def brute(rows: list[tuple[int, str | None]]) -> list[tuple]:
    chosen = ALL.chosen(RUNS)
    return sorted((k, f.ordinal, f.start, f.end, f.item_count) for k, t in rows for f in finders.find(t, chosen))


def found(df) -> list[tuple]:
    return sorted((r.k, r.ordinal, r.start, r.end, r.item_count) for r in df.collect())


@pytest.mark.parametrize("ends", [1, 2, 5, 1024])
def test_equal_to_finders_whatever_the_stretches(spark, ends):
    """Null, empty, repeated rows and extra columns too."""
    own = [(i, t) for i, t in enumerate(texts(400))] + [(0, "Bold. Clear. Now."), (0, "Bold. Clear. Now."), (900, None), (901, ""), (902, " \n "), (903, "...")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in own], "k int, text string, start string").repartition(3)
    expected = brute(own)
    assert {o for _, o, *_ in expected} == {o for o, _ in ALL.chosen(RUNS)}
    assert found(run_rows(docs, ["k"], ends=ends)) == expected


def test_empty_table_and_one_detector(spark):
    docs = spark.createDataFrame([], "k int, text string")
    assert run_rows(docs, ["k"]).count() == 0
    own = [(i, t) for i, t in enumerate(texts(100))]
    only = spark.createDataFrame(own, "k int, text string")
    ordinal = ALL.chosen(["staccato-fragments"])[0][0]
    assert found(run_rows(only, ["k"], ["staccato-fragments"])) == [r for r in brute(own) if r[1] == ordinal]


def test_no_python_and_no_window_over_texts(spark):
    plan = run_rows(spark.createDataFrame([(1, "a")], "k int, text string"), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_one_text_of_50_mb_over_many_tasks(spark):
    """A text of 50 MB: no task holds more than a share of its sentences, and a run that spans very many stretches is one find."""
    block = "".join(f"We went on to the {x} mill{' by day' * 150}. " for x in ("old", "new")) + "Perhaps. " * 4 + "x y z w. " * 2
    text = F.expr(f"concat(repeat('{block}', {50_000_000 // len(block)}), repeat('Now. ', 20000))")
    docs = spark.range(1).select(F.col("id").alias("k"), text.alias("text"))
    tasks = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("runs", "one long text")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        rows = {r.ordinal: r for r in run_rows(docs, ["k"]).groupBy("ordinal").agg(F.count("*").alias("n"), F.max("item_count").alias("most"), F.max("end").alias("end")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    stages = [tasks.getStageInfo(s) for j in tasks.getJobIdsForGroup("runs") for s in tasks.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) >= 8
    by_id = {ALL.ids[o]: r for o, r in rows.items()}
    n = 50_000_000 // len(block)
    assert by_id["echo-triad"].n >= n
    assert (by_id["staccato-fragments"].n, by_id["staccato-fragments"].most) == (n + 1, 20000)
    assert by_id["staccato-fragments"].end == len(block) * n + 20000 * 5 - 1


@pytest.mark.parametrize("whole", [0, 60, 1 << 20])
def test_all_runs_whatever_is_searched_whole(spark, whole):
    """Texts searched where they lie, texts dealt as stretches, and both; null, empty and repeated rows too."""
    own = [(i, t) for i, t in enumerate(texts(300))] + [(0, "Bold. Clear. Now."), (0, "Bold. Clear. Now."), (900, None), (901, "")]
    docs = spark.createDataFrame(own, "k int, text string").repartition(3)
    assert found(all_runs(docs, ["k"], whole=whole)) == brute(own)


def test_ordinary_texts_meet_no_shuffle(spark):
    plan = all_runs(spark.createDataFrame([(1, "a")], "k int, text string"), ["k"])._jdf.queryExecution().sparkPlan().toString()
    here, rows = plan.split("ArrowEvalPython")[0], plan
    assert "Exchange" not in here and "Window" not in here and "Generate" in here and rows.count("ArrowEvalPython") == 1


def test_hits_with_texts_searched_whole_or_not(spark, tmp_path, monkeypatch):
    spark.createDataFrame(list(enumerate(texts(300))), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    hits = lambda: sorted(map(tuple, queries.every_pattern_hits(spark, str(tmp_path)).collect()))
    expected = hits()
    assert {"echo-triad", "sentence-anaphora", "staccato-fragments"} < {r[0] for r in expected}
    monkeypatch.setattr(queries, "WHOLE", 300)
    monkeypatch.setattr(queries, "long_texts", lambda docs: long_texts(docs, 300))
    assert hits() == expected


def test_only_neighbours_that_may_echo_are_compared():
    """Four words that come again in a sentence further off, or within one, make no sentence worth a look."""
    text = "We went to the mill today. Nobody else was there then. " * 50
    assert finders._alike(text.lower()) == []
    assert finders._alike("one two three four one two three four. five.") == []
    assert finders._alike("x. a b c d e. b c d e f. y") == [1, 2]
    assert finders._alike("a b c d\n.\na b c d") == [0, 3]
