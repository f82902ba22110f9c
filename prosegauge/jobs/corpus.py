"""Corpus roll-ups of matches and grades, and the tables they are written to."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegauge.operators import detect
from prosegauge.operators.catalog import ALL, WIKI, Catalogue
from prosegauge.operators.grade import signal_rows


def match_table(docs: DataFrame, pattern_ids: Iterable[str] | None = None, among: Catalogue = ALL) -> DataFrame:
    """One row a match of docs(doc_id, text, ...), with the catalogue's columns."""
    return detect.labelled(detect.match_rows(detect.scan(docs, pattern_ids, among=among), [c for c in docs.columns if c != "text"], among), among)


def words(text: Column) -> Column:
    """Whitespace-parted words, counted by Arrow; not deterministic, so that a filter on them counts no second time."""

    @F.arrow_udf("int")
    def count(text: pa.Array) -> pa.Array:
        return pc.cast(pc.fill_null(pc.count_substring_regex(text, r"[^\t\n\x0B\f\r ]+"), 0), pa.int32())

    return count.asNondeterministic()(text)


def _own_counts(among: Catalogue) -> Column:
    """(ordinal, n) of the detectors that a document's finds are of."""
    each = F.transform(F.sequence(F.lit(0), F.lit(len(among) - 1)), lambda i: F.struct(i.alias("ordinal"), F.size(F.filter("found", lambda m: m["ordinal"] == i)).alias("n")))
    return F.filter(each, lambda x: x["n"] > 0)


def counts(docs: DataFrame, by: list[str], pattern_ids: Iterable[str] | None = None, among: Catalogue = ALL) -> DataFrame:
    """by, group, pattern_id, n_docs, n_words, hits, docs_hit, hits_per_1k_words for every combination of by and every detector, zeros included.

    One scan: each task first sums its own documents, so that a pattern that all
    documents hold is one row a task. A document also hands on its number of words.
    """
    all_words = F.array(F.struct(F.lit(-1).alias("ordinal"), F.col("_n_words").alias("n")))
    rows = detect.scan(docs, pattern_ids, among=among).withColumn("_n_words", words(F.col("text"))).select(*by, F.explode(F.concat(_own_counts(among), all_words)).alias("c"))
    sums = rows.groupBy(*by, "c.ordinal").agg(F.sum("c.n").alias("n"), F.count("*").alias("docs"))
    # As many entries as there are detectors, at most.
    held = sums.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("ordinal", F.struct("n", "docs")))).alias("m"))
    each = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(d.group).alias("group"), F.lit(d.pattern_id).alias("pattern_id")) for i, d in enumerate(among.detectors)])
    out = held.select(*by, "m", F.explode(each).alias("d"))
    total, own = F.col("m")[F.lit(-1)], F.try_element_at("m", F.col("d.ordinal"))
    out = out.select(*by, "d.group", "d.pattern_id", total["docs"].alias("n_docs"), total["n"].alias("n_words"), F.coalesce(own["n"], F.lit(0)).alias("hits"), F.coalesce(own["docs"], F.lit(0)).alias("docs_hit"))
    return out.withColumn("hits_per_1k_words", F.round(F.when(F.col("n_words") > 0, F.col("hits") * 1000 / F.col("n_words")), 6))


def rollup(scanned: DataFrame, among: Catalogue = ALL) -> DataFrame:
    """group, pattern_id, hits, docs: hits and documents with a hit by group and pattern, with a subtotal for each group and a total: nulls stand for all.

    Exact: a document is one row for each pattern, each group and the total that it has hits of, and rows are summed up in each task first.
    """
    groups, ids = (F.array(*map(F.lit, x)) for x in ([d.group for d in among.detectors], among.ids))
    own = F.transform(_own_counts(among), lambda x: F.struct(F.get(groups, x["ordinal"]).alias("group"), F.get(ids, x["ordinal"]).alias("pattern_id"), x["n"].alias("n")))
    sum_of = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["n"])
    none = F.lit(None).cast("string")
    by_group = F.transform(F.array_distinct(F.transform("own", lambda x: x["group"])), lambda g: F.struct(g.alias("group"), none.alias("pattern_id"), sum_of(F.filter("own", lambda x: x["group"] == g)).alias("n")))
    total = F.array(F.struct(none.alias("group"), none.alias("pattern_id"), sum_of("own").alias("n")))
    rows = scanned.where("n_matches > 0").select(own.alias("own")).select(F.explode(F.concat("own", by_group, total)).alias("r"))
    return rows.groupBy("r.group", "r.pattern_id").agg(F.sum("r.n").alias("hits"), F.count("*").alias("docs"))


def top_patterns(counted: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """The k patterns with most hits of each combination of by, ties by id; patterns without hits are left out."""
    w = Window.partitionBy(*by).orderBy(F.desc("hits"), "pattern_id")
    return counted.where("hits > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def densest(scanned: DataFrame, k: int = 20) -> DataFrame:
    """The k documents with most matches per thousand words, ties by doc_id."""
    n = F.col("_n_words")
    dense = F.round(F.when(n > 0, F.col("n_matches") * 1000 / n), 6)
    return scanned.select("doc_id", "n_matches", words(F.col("text")).alias("_n_words")).select("doc_id", "n_matches", dense.alias("per_1k_words")).where("per_1k_words IS NOT NULL").orderBy(F.desc("per_1k_words"), "doc_id").limit(k)


def group_split(scanned: DataFrame, keys: list[str], among: Catalogue = ALL) -> DataFrame:
    """keys, n_tic and n_wiki: a document's matches of the wiki group, and all others."""
    wiki = F.array(*[F.lit(i) for i, d in enumerate(among.detectors) if d.group == WIKI])
    n = F.size(F.filter("found", lambda m: F.array_contains(wiki, m["ordinal"])))
    return scanned.select(*keys, (F.size("found") - n).alias("n_tic"), n.alias("n_wiki"))


def tiers(graded: DataFrame, by: list[str]) -> DataFrame:
    """by, and the number of documents of each tier; eligible ones and others are told apart."""
    return graded.groupBy(*by, "eligible", "tier").agg(F.count("*").alias("n_docs"), F.sum("fired_count").alias("fired"))


def tier_table(graded: DataFrame, by: list[str]) -> DataFrame:
    """One row for each combination of by, one column a tier."""
    return graded.where("eligible").groupBy(*by).pivot("tier", ["low", "some", "elevated", "high"]).count().fillna(0)


def signal_rates(graded: DataFrame, by: list[str]) -> DataFrame:
    """by, key, and how many eligible documents the signal applies to and fires for."""
    rows = signal_rows(graded, by)
    return rows.groupBy(*by, "key").agg(F.count("*").alias("n_docs"), F.sum(F.col("applicable").cast("int")).alias("applicable"), F.sum(F.col("fired").cast("int")).alias("fired"))


def cofiring(graded: DataFrame) -> DataFrame:
    """(key_a, key_b, n_docs) for pairs of signals that fire in the same document; nine signals make 36 pairs at most."""
    keys = F.sort_array(F.transform(F.filter("signals", lambda s: s["fired"]), lambda s: s["key"]))
    pairs = F.flatten(F.transform(keys, lambda a: F.transform(F.filter(keys, lambda b: b > a), lambda b: F.struct(a.alias("key_a"), b.alias("key_b")))))
    return graded.select(F.explode(pairs).alias("p")).groupBy("p.key_a", "p.key_b").agg(F.count("*").alias("n_docs"))


def by_quality(graded: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by quality label and tier, with subtotals (cube): nulls stand for all."""
    rows = graded.select("doc_id", "tier").join(labels.select("doc_id", "quality"), "doc_id")
    return rows.cube("quality", "tier").agg(F.count("*").alias("n_docs"))


def by_role(conversations: DataFrame) -> DataFrame:
    """Hits of an assistant's manners and leftovers by role."""
    return counts(conversations, ["role"], ["chat-boilerplate", "ai-leftovers"]).where("pattern_id IN ('chat-boilerplate', 'ai-leftovers')")


def clean(graded: DataFrame, columns: list[str], tiers_out: tuple[str, ...] = ("elevated", "high")) -> DataFrame:
    """The columns of graded documents but those of these tiers: a filter on the document's own row."""
    return graded.where(~F.col("tier").isin(*tiers_out)).select(*columns)


def write_matches(matches: DataFrame, path: str, by: tuple[str, ...] = ("group", "lang")) -> None:
    """A match table as Parquet, one folder for each combination of by. Rows aren't dealt by these few values first, so no task gets all of one."""
    matches.write.partitionBy(*by).parquet(path)


def write_grades(graded: DataFrame, path: str, by: tuple[str, ...] = ("tier", "lang")) -> None:
    """Grades without their texts as Parquet, one folder for each combination of by."""
    graded.drop("text", "html", "segments").write.partitionBy(*by).parquet(path)
