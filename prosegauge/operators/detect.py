"""Detectors over a text column, and what is made of their finds.

Finds stay nested on the document's row until they are asked for as rows, so
that nothing is shuffled for them. Finders are marked as not deterministic:
otherwise the optimiser copies them below each filter on what they find, and
every text is searched twice.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.functions import finders
from prosegauge.functions.spans import covering

from .catalog import ALL, RUN_KINDS, Catalogue

#: Words to either side of a context.
CONTEXT_WORDS = 12
#: Characters of texts that are searched at once.
PART_CHARS = 1 << 21
FOUND = "array<struct<start:int,end:int,item_count:int,ordinal:int>>"
WINDOWS = "array<struct<start:int,end:int,n_regions:int,n_matches:int>>"
_NAMES = ["start", "end", "item_count", "ordinal"]


def default_ids() -> list[str]:
    return ALL.default_ids()


def ids_of(enabled: DataFrame) -> list[str]:
    """The pattern_ids of a table such as catalog.enabled(): at most as many as there are detectors."""
    return [r.pattern_id for r in enabled.select("pattern_id").distinct().collect()]


def parts(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """The texts in lists of at most PART_CHARS characters, or of one text: what is searched at once."""
    part, n = [], 0
    for t in texts:
        if part and n + len(t or "") > PART_CHARS:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t or "")
    if part:
        yield part


def nested(found: Iterable[finders.Find]) -> list[dict]:
    return [dict(zip(_NAMES, f, strict=True)) for f in found]


def resolved(found: Column) -> Column:
    """FOUND in order of start, then the longest, then the detectors' order; each is kept that begins no earlier than the last kept ended.

    Built-in functions alone: one sort, and one fold whose state is the last
    kept end and a byte a find (a fold copies its state at each step, so it
    holds no finds), then a filter by these bytes.
    """
    each = F.array_sort(F.transform(found, lambda f: F.struct(f["start"].alias("start"), (-f["end"]).alias("back"), f["ordinal"].alias("ordinal"), f["item_count"].alias("item_count"))))
    yes, no = F.lit(b"1"), F.lit(b"0")
    state = lambda end, marks: F.struct(end.alias("end"), marks.alias("marks"))
    step = lambda a, f: F.when(f["start"] >= a["end"], state(-f["back"], F.concat(a["marks"], yes))).otherwise(state(a["end"], F.concat(a["marks"], no)))
    marks = lambda own: F.aggregate(own, state(F.lit(-1), F.lit(b"")), step, lambda a: a["marks"])
    chosen = lambda x: F.filter(x["own"], lambda _, i: F.substring(x["marks"], i + 1, F.lit(1)) == yes)
    # Each value is bound before it is used for all finds, so that it is worked out once.
    bound = F.transform(F.array(each), lambda own: chosen_of(own, marks, chosen))
    out = F.transform(F.element_at(bound, 1), lambda f: F.struct(f["start"].alias("start"), (-f["back"]).alias("end"), f["item_count"].alias("item_count"), f["ordinal"].alias("ordinal")))
    return F.when(F.size(found) > 1, out).otherwise(found).cast(FOUND)


def chosen_of(own: Column, marks, chosen) -> Column:
    """chosen() of a struct of own and its marks."""
    return F.element_at(F.transform(F.array(F.struct(own.alias("own"), marks(own).alias("marks"))), chosen), 1)


def scan(docs: DataFrame, pattern_ids: Iterable[str] | None = None, cap: int | None = None, overlaps: bool = False, among: Catalogue = ALL, runs_up_to: int | None = None) -> DataFrame:
    """docs with found (FOUND), truncated and n_matches. Whole texts are scanned, or only their first `cap` characters.

    overlaps: every detector's finds as they are; otherwise they are resolved,
    earliest and longest first. among: the catalogue, with a user's detectors
    where there are any. runs_up_to: the length of the longest text that is
    searched for runs of sentences; those of longer ones come from
    runs.run_rows. Null and empty texts find nothing. Extra columns stay; those
    three are replaced.
    """
    chosen = among.chosen(pattern_ids)
    but_runs = [(o, d) for o, d in chosen if d.kind not in RUN_KINDS]

    def found(part: list[str | None]) -> list[list[finders.Find]]:
        if runs_up_to is None or all(len(t or "") <= runs_up_to for t in part):
            return finders.find_all(part, chosen)
        return [f for t in part for f in finders.find_all([t], chosen if len(t or "") <= runs_up_to else but_runs)]

    @F.pandas_udf(FOUND)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([nested(f if overlaps else finders.resolve(f)) for part in parts(s) for f in found(part)], dtype=object)

    out = docs.withColumn("found", of.asNondeterministic()(F.col("text") if cap is None else F.substring("text", 1, cap)))
    return out.withColumn("truncated", F.lit(False) if cap is None else F.coalesce(F.char_length("text") > cap, F.lit(False))).withColumn("n_matches", F.size("found"))


def match_rows(scanned: DataFrame, keys: list[str], among: Catalogue = ALL) -> DataFrame:
    """One row a match: keys, match_id (dense, from 0), pattern_id, start, end, item_count, snippet."""
    names = F.array(*map(F.lit, among.ids))
    rows = scanned.select(*keys, "text", F.posexplode("found").alias("match_id", "m"))
    return rows.select(*keys, "match_id", F.get(names, F.col("m.ordinal")).alias("pattern_id"), "m.start", "m.end", "m.item_count", F.expr("substring(text, m.start + 1, m.end - m.start)").alias("snippet"))


def per_pattern(scanned: DataFrame, keys: list[str], among: Catalogue = ALL) -> DataFrame:
    """keys and per_pattern, a map of every detector's id to its number of matches, zeros included."""
    counts = F.transform(F.sequence(F.lit(0), F.lit(len(among) - 1)), lambda i: F.size(F.filter("found", lambda m: m["ordinal"] == i)))
    return scanned.select(*keys, F.map_from_arrays(F.array(*map(F.lit, among.ids)), counts).alias("per_pattern"))


def labelled(matches: DataFrame, among: Catalogue = ALL) -> DataFrame:
    """match_rows with the catalogue's columns and a label: the detector's name, and how many of what where something is counted."""
    cat = F.broadcast(among.table(matches.sparkSession))  # a row a detector
    label = F.concat_ws(" · ", "name", F.when(F.col("item_count").isNotNull(), F.concat_ws(" ", F.col("item_count").cast("string"), F.col("counted"))))
    return matches.join(cat, "pattern_id").withColumn("label", label)


def matches_at(probes: DataFrame, matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """probes(key, pos) with the match that covers pos, or nulls: start <= pos < end. Resolved matches don't overlap, so there is one at most."""
    return covering(probes, matches.select(key, "start", "end", "match_id", "pattern_id"), key, "left").select(*probes.columns, "match_id", "pattern_id", "start", "end")


def context_windows(text: str | None, found: list[finders.Find], words: int = CONTEXT_WORDS) -> list[dict]:
    """The windows around the resolved matches of one text."""
    own = finders.regions(text, [f[:2] for f in found]) if text and found else []
    rows, at = [], 0
    for s, e, n in finders.windows(text, own, words) if own else []:
        rows.append({"start": s, "end": e, "n_regions": n, "n_matches": sum(x[2] for x in own[at : at + n])})
        at += n
    return rows


def contexts(docs: DataFrame, keys: list[str], pattern_ids: Iterable[str] | None = None, words: int = CONTEXT_WORDS, among: Catalogue = ALL) -> DataFrame:
    """One row a keyword-in-context extract: keys, window_id, start, end, n_regions, n_matches, context.

    A match's sentences are a region, touching regions are one; a window is a
    region with `words` words to either side, and windows that meet, or have no
    word between them, are one. They are formed in the pass that scans the text.
    """
    chosen = among.chosen(pattern_ids)

    @F.pandas_udf(WINDOWS)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([context_windows(t, finders.resolve(f), words) for part in parts(s) for t, f in zip(part, finders.find_all(part, chosen), strict=True)], dtype=object)

    rows = docs.select(*keys, "text", F.posexplode(of.asNondeterministic()("text")).alias("window_id", "w"))
    return rows.select(*keys, "window_id", "w.*", F.expr("substring(text, w.start + 1, w.end - w.start)").alias("context"))
