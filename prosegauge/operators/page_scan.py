"""Detectors over web pages: one pass flattens a page and scans its text; events in bins of places give the nodes that its matches lie in."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegauge.functions import finders
from prosegauge.functions.spans import BIN
from prosegauge.sources.pages import PAGE, flatten_html

from .catalog import ALL, Catalogue
from .detect import FOUND, nested, parts

def scan_pages(pages: DataFrame, pattern_ids: Iterable[str] | None = None, among: Catalogue = ALL, overlaps: bool = False) -> DataFrame:
    """pages with text, segments, li_total, li_bold, found and n_matches from html. Extra columns stay; those are replaced. overlaps: as in detect.scan()."""
    chosen = among.chosen(pattern_ids)

    @F.pandas_udf(PAGE.replace("text string", f"text string, found {FOUND}"))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for part in parts(s):
                flat = [flatten_html(html) for html in part]
                for (text, segments, total, bold), found in zip(flat, finders.find_all([x[0] for x in flat], chosen), strict=True):
                    rows.append((text, nested(found if overlaps else finders.resolve(found)), segments, total, bold))
            yield pd.DataFrame(rows, columns=["text", "found", "segments", "li_total", "li_bold"])

    names = ["text", "segments", "li_total", "li_bold", "found"]
    out = pages.drop(*names, "n_matches").select(F.struct("*").alias("row"), of.asNondeterministic()("html").alias("page"))
    out = out.select("row.*", *[F.col(f"page.{x}").alias(x) for x in names])
    return out.withColumn("n_matches", F.size("found"))


def node_rows(scanned: DataFrame, keys: list[str], among: Catalogue = ALL) -> DataFrame:
    """One row a match that has nodes: keys, match_id, pattern_id, start, end, first_seg, first_at, last_seg, last_at.

    The nodes that hold a match's first and last character; matches of no
    length, or with an edge between nodes, have none. Nodes and edges come out
    of the scanned row as events, dealt by bins of places (a node is in each bin
    that it reaches into); in a bin, in order of place, an edge's node is the
    last that began.
    """
    names, bin_of = F.array(*map(F.lit, among.ids)), lambda c: F.floor(c / BIN).cast("int")
    nothing = F.lit(None).cast("int")

    def event(at, pos, kind: int, number, start, end, ordinal):
        return F.struct(at.alias("bin"), pos.alias("pos"), F.lit(kind).alias("kind"), number.alias("number"), start.alias("start"), end.alias("end"), ordinal.alias("ordinal"))

    def node(s, i):
        upto = s["buf_start"] + s["len"]
        return F.transform(F.sequence(bin_of(s["buf_start"]), bin_of(upto - 1)), lambda b: event(b, F.greatest(s["buf_start"], b * BIN), 0, i, s["buf_start"], upto, nothing))

    edge = lambda kind, place: F.transform("found", lambda m, i: event(bin_of(place(m)), place(m), kind, i, m["start"], m["end"], m["ordinal"]))
    edges = F.filter(F.concat(edge(1, lambda m: m["start"]), edge(2, lambda m: m["end"] - 1)), lambda e: e["end"] > e["start"])
    rows = scanned.select(*keys, F.explode(F.concat(F.flatten(F.transform("segments", node)), edges)).alias("e"))
    before = Window.partitionBy(*keys, "e.bin").orderBy("e.pos", "e.kind")
    at = F.last(F.when(F.col("e.kind") == 0, F.col("e")), ignorenulls=True).over(before)
    held = rows.withColumn("n", at).where("e.kind > 0 AND e.pos < n.end")
    side = lambda kind, c: F.max(F.when(F.col("e.kind") == kind, c))
    number, place = F.col("n.number"), F.col("e.pos") - F.col("n.start")
    out = held.groupBy(*keys, F.col("e.number").alias("match_id")).agg(
        F.get(names, F.max("e.ordinal")).alias("pattern_id"), F.max("e.start").alias("start"), F.max("e.end").alias("end"),
        side(1, number).alias("first_seg"), side(1, place).alias("first_at"), side(2, number).alias("last_seg"), side(2, place).alias("last_at"),
    )
    return out.where("first_seg IS NOT NULL AND last_seg IS NOT NULL")
