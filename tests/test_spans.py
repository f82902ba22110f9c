"""Overlaps by built-in functions, places in bins, text nodes as a browser has them."""

import random
import time

from pyspark.sql import functions as F

from prosegauge.functions import finders
from prosegauge.functions.spans import BIN, covering
from prosegauge.operators import detect
from prosegauge.operators.page_scan import node_rows, scan_pages
from prosegauge.sources import pages

FINDS = "k int, found " + detect.FOUND


def test_overlaps_are_resolved_as_one_after_the_other(spark):
    rng = random.Random(11)
    rows = []
    for k in range(60):
        starts = [rng.randrange(200) for _ in range(rng.randrange(0, 40) if k else 3000)]
        rows.append((k, [(s, s + rng.randrange(1, 30), rng.choice([None, 2]), rng.randrange(63)) for s in starts]))
    rows.append((99, [(i, i + 1, None, 3) for i in range(1500)]))
    got = spark.createDataFrame([*rows, (100, None)], FINDS).select("k", detect.resolved(F.col("found")).alias("f")).collect()
    for r in got:
        want = dict(rows).get(r.k)
        assert r.f is None if want is None else [tuple(x) for x in r.f] == [tuple(x) for x in finders.resolve([finders.Find(*w) for w in want])]


def test_a_hundred_thousand_finds_are_resolved_in_time(spark):
    row = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: F.struct((i * 2).alias("start"), (i * 2 + 2).alias("end"), F.lit(None).cast("int").alias("item_count"), F.lit(1).alias("ordinal"))).alias("found"))
    run = lambda df: df.select(F.size(detect.resolved(F.col("found"))).alias("n")).first().n
    run(row.select(F.slice("found", 1, 100).alias("found")))
    began = time.time()
    assert run(row) == 100_000 and time.time() - began < 2 + 2  # two seconds for the plan on few cores


def test_covering(spark):
    rng = random.Random(12)
    spans, at = [], 0
    for i in range(300):
        at += rng.choice([0, 1, 7, BIN])
        end = at + rng.choice([0, 1, 5, 3 * BIN])
        spans.append((1, at, end, i))
        at = end
    probes = [(1, rng.randrange(at)) for _ in range(2000)] + [(2, 5), (1, None), (None, 3)]
    s, p = spark.createDataFrame(spans, "id int, start int, end int, n int"), spark.createDataFrame(probes, "id int, pos int")
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    want = sorted(((k, pos, *next(((a, b, n) for _, a, b, n in spans if k == 1 and pos is not None and a <= pos < b), (None,) * 3)) for k, pos in probes), key=key)
    assert sorted(map(tuple, covering(p, s, "id", "left").collect()), key=key) == want
    assert covering(p, s, "id").count() == sum(w[2] is not None for w in want)


def test_very_many_probes_of_one_text(spark):
    text = spark.createDataFrame([(1, "It just works. " * 20_000)], "doc_id long, text string")
    found = detect.match_rows(detect.scan(text, ["fits-in-your-head"]), ["doc_id"])
    probes = spark.range(1_000_000).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") % 300_000).cast("int").alias("pos"))
    assert detect.matches_at(probes, found).where("match_id IS NOT NULL").count() == sum((i % 300_000) % 15 < 13 for i in range(1_000_000))


def test_text_nodes(spark):
    for html, want in (
        ("<p>5 < 6 it works</p>", [("5 < 6 it works", "p")]), ("<p>a</i>b</p>", [("ab", "p")]), ("<p>a<!-- c -->b</p>", [("a", "p"), ("b", "p")]), ("<p>a<b>c</b>d", [("a", "p"), ("c", "b"), ("d", "p")]),
        ("a &lt; b & c", [("a < b & c", None)]), ("<p>x<script>1 < 2</script>y</p>", [("x", "p"), ("y", "p")]),
    ):
        text, segments, _, _ = pages.flatten_html(html)
        assert [(text[s["buf_start"] : s["buf_start"] + s["len"]], s["parent_tag"]) for s in segments] == want


def test_nodes_of_a_long_page(spark):
    html = "<p>" + "<i>in</i> order <b>to</b> go, " * 400 + "x" * (5 * BIN) + " It just works."
    web = spark.createDataFrame([(1, "http://a.org", html)], "page_id long, url string, html string")
    scanned = scan_pages(web, ["verb-inflation", "fits-in-your-head"])
    rows = node_rows(scanned, ["page_id"])
    joined = pages.in_segments(detect.match_rows(scanned, ["page_id"]), pages.segment_rows(scanned, ["page_id"])).select(*rows.columns)
    got = sorted(map(tuple, rows.collect()))
    assert len(got) == 401 and got == sorted(map(tuple, joined.collect()))
