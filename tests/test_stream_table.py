"""The table of grades that a stream keeps: bursts, settings, batches run again, bounded folders; and the SQL check's flattening."""

import os
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pytest

from prosegauge.operators.catalog import ALL
from prosegauge.operators.detect import per_pattern
from prosegauge.operators.page_scan import scan_pages
from prosegauge.oracle_pages import flat_ctes
from prosegauge.sources.pages import flatten_html
from prosegauge.sources.seeds import HTML
from prosegauge.streaming import pages as stream

T = datetime(2024, 1, 1)
TEXTS = ["<p>It just works.</p>", "<p>In order to go.</p>", "<p>Studies show it, in order to go. Timing is everything.</p>", "<p>Plain.</p>"]


def begun(spark, path, buckets=2):
    """A table of grades without a batch."""
    (path / "none").mkdir()
    stream.upsert_grades(stream.versions(spark, str(path / "none")), str(path / "t"), str(path / "c"), buckets=buckets).awaitTermination()
    return str(path / "t")


def batch(spark, rows):
    return spark.createDataFrame([(page, T + timedelta(seconds=at), f"http://p{page}.org", html) for page, at, html in rows], stream.VERSIONS)


def counts(rows):
    """Hits of each detector by page."""
    return {r.page_id: r.per_pattern for r in per_pattern(rows, ["page_id"]).collect()}


def folders(table):
    return sorted(os.path.relpath(d, table) for d, _, files in os.walk(f"{table}/rows") if any(f.endswith(".parquet") for f in files))


def test_a_table_without_batches_is_empty(spark, tmp_path):
    table = begun(spark, tmp_path)
    assert stream.current(spark, table).collect() == []
    stream.write_batch(batch(spark, []), 0, table)  # an empty batch writes nothing
    assert stream.current(spark, table).collect() == []


def test_many_batches_leave_bounded_folders_and_the_newest_grades(spark, tmp_path):
    table = begun(spark, tmp_path)
    expected = {}
    for i in range(9):
        rows = [(page, 10 * i + (page == 3) * -100 * i, TEXTS[(i + page) % 4]) for page in range(5) if page != 4 or i == 2]
        stream.write_batch(batch(spark, rows), i, table)
        for page, at, html in rows:
            expected[page] = max(expected.get(page, (-1e9, "")), (at, html))
        assert len(folders(table)) <= 2 * stream.SLOTS
        assert len(os.listdir(f"{table}/manifest")) <= 2
    got = stream.current(spark, table)
    assert {r.page_id: r.version_ts for r in got.collect()} == {k: T + timedelta(seconds=v[0]) for k, v in expected.items()}
    assert counts(got) == counts(scan_pages(batch(spark, [(k, *v) for k, v in expected.items()])))


def test_a_batch_run_again_gives_the_same_table(spark, tmp_path):
    table = begun(spark, tmp_path)
    rows = lambda: sorted(map(str, stream.current(spark, table).collect()))
    stream.write_batch(batch(spark, [(1, 0, TEXTS[0]), (2, 0, TEXTS[1])]), 0, table)
    second = batch(spark, [(1, 5, TEXTS[2]), (3, 5, TEXTS[0])])
    stream.write_batch(second, 1, table)
    first = rows()
    stream.write_batch(second, 1, table)  # failed after its manifest was written
    assert rows() == first and len(first) == 3
    # Failed before the manifest: what it wrote to free slots isn't seen.
    stream.write_batch(batch(spark, [(1, 9, TEXTS[3])]), 2, table)
    turn = stream._manifest(spark, table).turn
    for f in os.listdir(f"{table}/manifest/turn={turn}"):
        os.remove(f"{table}/manifest/turn={turn}/{f}")
    assert rows() == first
    stream.write_batch(batch(spark, [(1, 9, TEXTS[3])]), 2, table)
    assert [r.n_matches for r in stream.current(spark, table).where("page_id = 1").collect()] == [0]


def test_a_reader_that_is_overtaken_is_told_so(spark, tmp_path):
    table = begun(spark, tmp_path, buckets=1)
    stream.write_batch(batch(spark, [(1, 0, TEXTS[0])]), 0, table)
    live = stream._manifest(spark, table)
    for i in range(1, 1 + stream.SLOTS):
        stream.write_batch(batch(spark, [(1, i, TEXTS[0])]), i, table)
    with pytest.raises(Exception, match="read it again"):
        stream._held(spark, table, live).collect()


def test_settings_count_for_all_pages_without_reading_them_again(spark, tmp_path):
    table = begun(spark, tmp_path)
    last = {1: TEXTS[0], 2: TEXTS[2], 3: TEXTS[1]}
    stream.write_batch(batch(spark, [(1, 0, TEXTS[0]), (2, 0, TEXTS[1])]), 0, table)
    wiki_off = [d.pattern_id for d in ALL.detectors if d.group != "wiki"]
    assert sum(sum(v.values()) for v in counts(stream.current(spark, table, wiki_off)).values()) == 2
    stream.write_batch(batch(spark, [(2, 5, TEXTS[2]), (3, 0, TEXTS[1])]), 1, table)
    fresh = batch(spark, [(k, 0, v) for k, v in last.items()])
    for ids in (None, wiki_off, ALL.ids, ["verb-inflation"], []):
        assert counts(stream.current(spark, table, ids)) == counts(scan_pages(fresh, ids))


def test_three_bursts_give_the_last_closed_version(spark, tmp_path):
    rows = [(1, at, html) for at, html in ((0, TEXTS[0]), (2, TEXTS[3]), (60, TEXTS[0]), (63, TEXTS[1]), (300, TEXTS[0]), (303, TEXTS[2]))]
    rows += [(2, 0, TEXTS[0]), (2, 400, TEXTS[2])]  # the last one's burst is open still
    batch(spark, rows).repartition(4).write.parquet(str(tmp_path / "in"))
    settled = stream.settled(stream.versions(spark, str(tmp_path / "in")), late="0 seconds")
    stream.upsert_grades(settled, str(tmp_path / "t"), str(tmp_path / "c"), buckets=2).awaitTermination()
    got = {r.page_id: (r.version_ts, r.n_matches) for r in stream.current(spark, str(tmp_path / "t")).collect()}
    assert got == {1: (T + timedelta(seconds=303), 3), 2: (T, 1)}


def test_sql_flattens_as_the_parser_does():
    own = [
        f"<html><head><title>t</title><script>var a = '</p>'</script></head><body><h1>A &amp; b</h1><p>One <b>two<br><p>three&amp</p>\n<ul><li>x</li><li><b>y</b></li></ul>{part}</body>"
        for part in (*HTML, "", "<p>open" + HTML[1], "<div>text<!-- c -->more\n</div><footer>&copy; end</footer>")
    ]
    c = duckdb.connect()
    c.register("pages_", pa.table({"id": list(range(len(own))), "html": own}))
    got = c.sql(f"WITH {flat_ctes('SELECT id, html FROM pages_')} SELECT t, li_total, li_bold, l FROM flat JOIN (SELECT id, list([buf_start, len] ORDER BY seg_idx) AS l FROM nodes GROUP BY id) USING (id) ORDER BY id").fetchall()
    for html, (text, total, bold, nodes) in zip(own, got, strict=True):
        t, segments, a, b = flatten_html(html)
        assert (text, total, bold, nodes) == (t, a, b, [[s["buf_start"], s["len"]] for s in segments])
