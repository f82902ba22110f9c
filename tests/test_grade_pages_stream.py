"""Grades, pages and streams."""

from datetime import datetime, timedelta

from prosegauge.jobs import corpus
from prosegauge.operators.grade import grade, signal_rows
from prosegauge.sources import pages
from prosegauge.streaming import pages as stream

EVEN = "Moreover, the plan is not just fast but also cheap for all — a calm, clear, and kind step for us today. "


def test_machine_like_text_fires(spark):
    text = "\n".join([EVEN * 4] * 4) + " “quoted” and more…"
    r = grade(spark.createDataFrame([(1, text, 4, 3)], "doc_id long, text string, li_total int, li_bold int")).first()
    fired = {s.key for s in r.signals if s.fired}
    assert {"burstiness", "para-uniform", "em-dash", "transitions", "antithesis", "typography", "bold-list"} <= fired
    assert r.eligible and r.tier in ("elevated", "high") and r.badge.text == str(r.fired_count)


def test_short_null_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "Too short.", "x"), (2, None, "y")], "doc_id long, text string, tier string")
    for r in grade(docs).collect():
        assert not r.eligible and r.signals == [] and r.tier == "low" and r.badge is None and r.fired_count == 0
    assert signal_rows(grade(docs), ["doc_id"]).count() == 0
    assert corpus.tier_table(grade(docs), ["doc_id"]).count() == 0


def test_flatten():
    html = """<html><head><title>t</title></head><body><p>One <b>two</b></p><script>var x = '</p>';</script><div hidden>no</div>
    <p style="display: none">no</p><textarea>no</textarea><div contenteditable="true">no<p>no</p></div>
    <ul><li><strong>A</strong> x</li><li>b <i>c</i></li><li hidden><b>d</b></li></ul>&amp; end</body></html>"""
    text, segments, total, bold = pages.flatten_html(html)
    assert "no" not in text and "var" not in text and "t\n" not in text[:2]
    assert "One two\n" in text and text.rstrip().endswith("& end") and (total, bold) == (3, 2)
    for s in segments:
        assert text[s["buf_start"] : s["buf_start"] + s["len"]]
    assert pages.flatten_html(None) == ("", [], 0, 0)


def test_an_unclosed_head_ends_at_the_body():
    for head in ("<html><head><title>T</title>", "<head><meta charset=utf-8><title>T</title>", "<html><head><title>T</title><body>", "<title>T</title>"):
        assert pages.flatten_html(head + "<h1>Hello</h1><p>there")[0] == "Hello\nthere"


def test_unicode_blanks_part_sentences_and_words_of_openers(spark):
    rows = [(1, "One is here.\u00a0Two is there.\u2003However's odd. ’Moreover so. However, yes. " + "It\u00a0is late. " * 10)]
    r = grade(spark.createDataFrame(rows, "doc_id long, text string")).first()
    assert r.n_sentences == 15
    long = spark.createDataFrame([(1, rows[0][1] + "word " * 150)], "doc_id long, text string")
    by = {s.key: s for s in grade(long).first().signals}
    assert by["transitions"].value == 1 / 16 and by["expletives"].value == 10 / 16 and by["expletives"].display == "63% of the sentences"


def test_pages_in_one_pass_agree_with_joins(spark):
    from prosegauge.operators import detect
    from prosegauge.operators.page_scan import node_rows, scan_pages

    html = ["<p>It just <b>works</b>, and it <i>just works</i>.</p><p>It just</p><p>works, in order to</p>", "<div hidden>it just works</div><p>In <i>order</i> to go", None, ""]
    table = spark.createDataFrame([(i, f"http://a{i}.org", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    flat = pages.flatten(table)
    joined = pages.in_segments(detect.match_rows(detect.scan(flat), ["page_id"]), pages.segment_rows(flat, ["page_id"]))
    own = node_rows(scan_pages(table), ["page_id"])
    names = own.columns
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, joined.select(*names).collect())) and own.count() == 5


def test_urls(spark):
    rows = [(1, "HTTPS://u:p@Ex.org:443/a"), (2, "http://ex.org:8080?q"), (3, "ftp://x"), (4, None), (5, " ex.org/p ")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.o, r.n) for r in df.select("page_id", pages.origin(df.url).alias("o"), pages.normalised(df.url).alias("n")).collect()}
    assert got == {1: ("https://ex.org", "HTTPS://u:p@Ex.org:443/a"), 2: ("http://ex.org:8080", "http://ex.org:8080?q"), 3: (None, ""), 4: (None, ""), 5: (None, "https://ex.org/p")}
    listed = spark.createDataFrame([("https://ex.org",)], "origin string")
    assert [r.page_id for r in pages.allowed(df, listed).collect()] == [1]
    assert pages.allowed(df, listed, keep=False).count() == 4


def test_match_nodes(spark):
    nodes = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 5, 4), (1, 2, 10, 5)], "page_id long, seg_idx int, buf_start int, len int")
    rows = spark.createDataFrame([(1, 0, 3, 8), (1, 1, 9, 12), (1, 2, 4, 4)], "page_id long, match_id int, start int, end int")
    got = [(r.match_id, r.first_seg, r.first_at, r.last_seg, r.last_at) for r in pages.in_segments(rows, nodes).collect()]
    assert got == [(0, 0, 3, 1, 2)]
    probes = spark.createDataFrame([(1, 1, 2), (1, 1, 99), (1, 7, 0)], "page_id long, seg_idx int, offset int")
    assert sorted(r.buf_offset for r in pages.buffer_offsets(probes, nodes).collect()) == [-1, 7, 9]


def test_stream(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(1, t, "http://a.org", "<p>old</p>"), (1, t + timedelta(seconds=2), "http://a.org", "<p>It just works.</p>"), (2, t, "http://b.org", "<p>x</p>")]
    spark.createDataFrame(rows, stream.VERSIONS).write.parquet(str(tmp_path / "in"))
    q = stream.upsert_grades(stream.versions(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), spark.createDataFrame([("http://a.org",)], "origin string"))
    q.awaitTermination()
    got = stream.current(spark, str(tmp_path / "out")).collect()
    assert [(r.page_id, r.n_matches) for r in got] == [(1, 1)]
    # Later batches replace a page's grade, older versions don't, and other pages stay.
    for k, (page, at, html) in enumerate([(1, t + timedelta(seconds=9), "<p>Fine.</p>"), (1, t, "<p>It just works.</p>"), (3, t, "<p>In order to.</p>")]):
        spark.createDataFrame([(page, at, "http://a.org", html)], stream.VERSIONS).write.mode("append").parquet(str(tmp_path / "in"))
        stream.upsert_grades(stream.versions(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), spark.createDataFrame([("http://a.org",)], "origin string")).awaitTermination()
    assert sorted((r.page_id, r.n_matches) for r in stream.current(spark, str(tmp_path / "out")).collect()) == [(1, 0), (3, 1)]


def test_pattern_monitor_counts_by_window(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(1, t, "http://a.org", "<p>It just works. It just works.</p>"), (2, t + timedelta(minutes=1), "http://a.org", "<p>It just works in order to.</p>"), (3, t + timedelta(minutes=30), "http://a.org", "<p>x</p>")]
    spark.createDataFrame(rows, stream.VERSIONS).write.parquet(str(tmp_path / "in"))
    frame = stream.pattern_monitor(stream.versions(spark, str(tmp_path / "in")), late="0 seconds")
    frame.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.pattern_id, r.hits, r.n_pages) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("fits-in-your-head", 3, 2), ("verb-inflation", 1, 1)}


def test_corpus_counts_against_matches(spark):
    docs = spark.createDataFrame([(1, "It just works. It just works.", "en"), (2, "none", None), (3, "Timing is everything.", "en")], "doc_id long, text string, lang string")
    counted = {(r.lang, r.pattern_id): (r.hits, r.docs_hit) for r in corpus.counts(docs, ["lang"]).collect()}
    assert len(counted) == 126 and counted["en", "fits-in-your-head"] == (2, 1) and counted["en", "pseudo-wisdom"] == (1, 1) and counted[None, "whole"] == (0, 0)
    assert corpus.match_table(docs).count() == 3
