"""Spans of one phrase as a column expression, without Python workers, and spans that cover a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions.phrases import Phrase

SPANS = "array<struct<start:int,end:int,item_count:int>>"


def phrase_spans(text: Column, p: Phrase) -> Column:
    """(start, end, null) of each match, leftmost first, not overlapping; none for null texts.

    What a split leaves and what an extraction takes alternate, so the starts
    are sums of both lengths. The sums are folded, so this suits phrases found
    a few times in a text.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(p.java), F.lit(0)), F.split(text, p.java, -1)
    start = lambda s, x: s["at"] + F.char_length(x["gap"])
    found = F.aggregate(
        F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit")),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")),
        lambda s, x: F.struct(
            (start(s, x) + F.char_length(x["hit"])).alias("at"),
            F.array_append(s["out"], F.struct(start(s, x).alias("start"), (start(s, x) + F.char_length(x["hit"])).alias("end"), F.lit(None).cast("int").alias("item_count"))).alias("out"),
        ),
        lambda s: s["out"],
    )
    return F.when(text.rlike(p.java), found).otherwise(F.array().cast(SPANS))


#: Places of a bin.
BIN = 1024


def covering(probes: DataFrame, spans: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """probes(key, pos, ...) with the columns of the span of spans(key, start, end, ...) that covers pos: start <= pos < end.

    Both sides are joined by key and bin of places, and a span is copied to each
    bin that it reaches into, so that a text with very many probes and spans
    doesn't hold all of the one against all of the other. how: inner, or left
    (nulls where no span covers). Spans that overlap give a row each; spans of
    no length, and null places, are covered by none. No column of either side
    may be in the other, but for key, or be called _bin.
    """
    at = lambda c: F.floor(c / BIN).cast("int")
    cut = spans.where("end > start").withColumn("_bin", F.explode(F.sequence(at(F.col("start")), at(F.col("end") - 1))))
    dealt = probes.withColumn("_bin", at(F.col("pos")))
    p, s = dealt.alias("p"), cut.alias("s")
    on = (F.col(f"p.{key}") == F.col(f"s.{key}")) & (F.col("p._bin") == F.col("s._bin")) & (F.col("p.pos") >= F.col("s.start")) & (F.col("p.pos") < F.col("s.end"))
    return p.join(s, on, how).select("p.*", *[f"s.{c}" for c in spans.columns if c != key]).drop("_bin")
