"""Runs of sentences (echo-triad, sentence-anaphora, staccato-fragments) as rows.

all_runs() has a task search its texts whole, but for huge ones: run_rows()
finds theirs, or those of any texts, without Python workers. A text is cut behind sentences' ends into stretches. Stretches, not texts, are
dealt over the tasks; a sentence is a row of its stretch, and a run is an
island of rows of which each is linked to the next. Runs that touch a
stretch's edge meet their neighbours' in a second pass over at most two rows a
stretch, so that one huge text is never one task's window. Texts of one
stretch in which no two neighbouring sentences are alike make no rows at all.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.functions.finders import ABBREVIATIONS, COMMON_OPENERS
from prosegauge.functions.phrases import JAVA_BLANK

from . import detect
from .catalog import ALL, DETECTORS, RUN_KINDS

RUNS = [d.pattern_id for d in DETECTORS if d.kind in RUN_KINDS]
#: Characters of the longest text that one task searches whole: longer ones are cut into stretches.
WHOLE = 1 << 20
#: Ends of sentences a stretch.
STRETCH = 1024
#: A sentence's place in its piece, blanks at either end that a run leaves out, and what it shares with the next one where both are linked (null: no sentence).
_ITEMS = "array<struct<n:int,start:int,stop:int,lead:int,tail:int,sign:array<string>>>"
_BLANKS = "".join(c for c in map(chr, range(0x10000)) if re.fullmatch(JAVA_BLANK, c))
_GAP = 3  # characters that may lie between linked sentences


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pieces(text: Column, ends: int) -> Column:
    """Stretches of a text, in order: (at, piece, many). Each is cut behind a run of stops or a line break, the last one excepted."""
    cut = F.regexp_extract_all(text, F.lit(rf"(?:[^.!?\n]*+(?:[.!?]++|\n)){{1,{ends}}}+|[^.!?\n]++"), F.lit(0))

    def placed(own: Column) -> Column:
        ats = F.aggregate(own, F.array(F.lit(0)), lambda a, p: F.array_append(a, F.element_at(a, -1) + F.char_length(p)))
        return F.transform(F.arrays_zip(F.slice(ats, 1, F.size(own)).alias("at"), own.alias("piece")), lambda x: F.struct(x["at"].alias("at"), x["piece"].alias("piece"), (F.size(own) > 1).alias("many")))

    return _bound(cut, placed)


def _item(token: Column, start: Column, sign: Column, lead: Column | None = None, tail: Column | None = None) -> Column:
    n, none = F.char_length(token), F.lit(0)
    return F.struct(n.alias("n"), start.alias("start"), n.alias("stop"), (none if lead is None else lead).alias("lead"), (none if tail is None else tail).alias("tail"), sign.alias("sign"))


def _echo(piece: Column) -> Column:
    """Sentences of at least four words, by their sequences of four."""
    def of(token: Column) -> Column:
        words = F.regexp_extract_all(F.lower(token), F.lit("[a-z0-9'’-]+"), F.lit(0))
        fours = lambda w: F.when(F.size(w) >= 4, F.transform(F.sequence(F.lit(0), F.size(w) - 4), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(4)]))).otherwise(F.array().cast("array<string>"))
        long = F.regexp_count(token, F.lit(f"[^{JAVA_BLANK[1:-1]}]+")) >= 4
        return _item(token, F.lit(0), F.when(long, _bound(words, fours)), tail=F.char_length(token) - F.char_length(F.rtrim(token, F.lit(_BLANKS))))

    return F.transform(F.regexp_extract_all(piece, F.lit(r"[^.!?\n]++[.!?]?|[.!?\n]++"), F.lit(0)), of)


def _closed(piece: Column, stops: str, most: int, item: Callable[[Column, Column, Column], Column]) -> Column:
    """item(token, body, own) of each text up to its stops: own is at most `most` characters before them, of their line."""
    def of(token: Column) -> Column:
        body = F.rtrim(token, F.lit(".!?"))
        own = F.when(F.char_length(body) < F.char_length(token), F.right(F.substring_index(body, "\n", -1), F.lit(most))).otherwise("")
        return _bound(F.struct(token.alias("token"), body.alias("body"), own.alias("own")), lambda x: item(x["token"], x["body"], x["own"]))

    return F.transform(F.regexp_extract_all(piece, F.lit(rf"[^.!?]*+{stops}|[^.!?]++"), F.lit(0)), of)


def _anaphora(piece: Column) -> Column:
    """Sentences by their first word."""
    def item(token: Column, body: Column, own: Column) -> Column:
        head = F.regexp_extract(own, "[A-Za-z'’-]+", 0)
        start = F.char_length(body) - F.char_length(own) + F.call_function("locate", head, own) - 1
        return _item(token, start, F.when(head != "", F.array(F.lower(head))))

    return _closed(piece, "[.!?]", 400, item)


def _staccato(piece: Column) -> Column:
    """Sentences by whether they are one or two words with a letter, no abbreviation last."""
    short = f"\\A{JAVA_BLANK}*+[^{JAVA_BLANK[1:-1]}]++(?:{JAVA_BLANK}++[^{JAVA_BLANK[1:-1]}]++)?\\z"
    abbreviated = rf"(?:\A|{JAVA_BLANK})(?:{'|'.join(sorted(ABBREVIATIONS))}|[a-z])\.\z"

    def item(token: Column, body: Column, own: Column) -> Column:
        sentence = F.concat(own, F.call_function("substr", token, F.char_length(body) + 1))
        is_short = sentence.rlike(short) & sentence.rlike("[A-Za-z]") & ~F.lower(sentence).rlike(abbreviated)
        sign = F.when(is_short, F.array(F.lit("short"))).otherwise(F.array().cast("array<string>"))
        return _item(token, F.char_length(body) - F.char_length(own), F.when(own != "", sign), lead=F.char_length(own) - F.char_length(F.ltrim(own, F.lit(_BLANKS))))

    return _closed(piece, "[.!?]++", 40, item)


_KINDS = {"echo": (_echo, 2), "anaphora": (_anaphora, 3), "staccato": (_staccato, 3)}


def _may_hold(items: Column) -> Column:
    """Whether two neighbouring sentences are alike, however far apart."""
    signs = F.filter(F.transform(items, lambda x: x["sign"]), lambda s: s.isNotNull())
    return _bound(signs, lambda s: F.exists(F.arrays_zip(s.alias("a"), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))).alias("b")), lambda x: F.arrays_overlap(x["a"], x["b"])))


def run_rows(docs: DataFrame, keys: list[str], pattern_ids: Iterable[str] | None = None, ends: int = STRETCH) -> DataFrame:
    """One row a find of these detectors (default: all three): keys, row_id, ordinal, start, end, item_count; overlaps as they are.

    docs: keys and text. row_id tells rows of equal keys apart: repeated rows
    find the same, each for itself. Null and empty texts find nothing. ends:
    ends of sentences a stretch; results don't depend on it. A single sentence
    is never cut, so a text without any stop or line break is one row. Edges of
    a text meet in one task: two rows a stretch.
    """
    kinds = [(o, *_KINDS[d.kind]) for o, d in ALL.chosen(RUNS if pattern_ids is None else pattern_ids) if d.kind in _KINDS]
    # In a step of its own: beside an explode, ids would be given after it.
    numbered = docs.select(F.struct(*keys).alias("keys"), F.monotonically_increasing_id().alias("row_id"), "text")
    cut = numbered.select("keys", "row_id", F.posexplode(_pieces(F.col("text"), ends)).alias("stretch", "p"))
    # An explode of one list or none, not a filter: the optimiser would evaluate what a filter looks at twice.
    held = F.array_compact(F.array(*[F.when(F.col("p.many") | _may_hold(items(F.col("p.piece"))), F.lit(o)) for o, items, _ in kinds]))
    holding = cut.withColumn("held", F.explode(_bound(held, lambda h: F.when(F.size(h) > 0, F.array(h)))))
    # A fixed number: pieces are few bytes but many rows, and would be put together by their bytes.
    n_tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = holding.repartition(n_tasks, "row_id", "stretch").withColumn("ordinal", F.explode("held"))
    items = F.coalesce(*[F.when(F.col("ordinal") == o, items(F.col("p.piece")).cast(_ITEMS)) for o, items, _ in kinds])
    whole = ["row_id", "stretch", "ordinal"]
    sentences = dealt.select("keys", *whole, F.col("p.at").alias("at"), F.col("p.many").alias("many"), F.posexplode(items).alias("i", "x"))

    own = Window.partitionBy(*whole).orderBy("i")
    placed = sentences.withColumn("from", F.col("at") + F.sum("x.n").over(own).cast("int") - F.col("x.n")).where("x.sign IS NOT NULL")
    placed = placed.select("keys", *whole, "many", "i", (F.col("from") + F.col("x.start")).alias("start"), (F.col("from") + F.col("x.stop")).alias("end"), "x.lead", "x.tail", F.col("x.sign").alias("sign"))
    linked = (F.col("start") - F.lag("end").over(own) <= _GAP) & F.arrays_overlap("sign", F.lag("sign").over(own))
    islands = placed.withColumn("new", F.when(linked, 0).otherwise(1)).withColumn("island", F.sum("new").over(own))
    first, last = (lambda c: F.min_by(c, "i")), (lambda c: F.max_by(c, "i"))
    islands = islands.groupBy(*whole, "island").agg(
        F.first("keys").alias("keys"), F.first("many").alias("many"), F.min("start").alias("start"), F.max("end").alias("end"), first("lead").alias("lead"), last("tail").alias("tail"),
        first("sign").alias("head"), last("sign").alias("sign"), F.count("*").alias("n"),
    )
    by_island = Window.partitionBy(*whole)
    edge = F.col("many") & ((F.col("island") == 1) | (F.col("island") == F.max("island").over(by_island)))
    least = F.coalesce(*[F.when(F.col("ordinal") == o, F.lit(n)) for o, _, n in kinds])
    # Edges of a text are one group, inner runs stay with their stretch.
    kept = islands.withColumn("place", F.when(edge, F.lit(-1)).otherwise(F.col("stretch"))).where((F.col("place") < 0) | (F.col("n") >= least))

    beside = Window.partitionBy("row_id", "ordinal", "place").orderBy("start")
    # Two islands of one stretch were held against each other already.
    meets = (F.lag("stretch").over(beside) != F.col("stretch")) & (F.col("start") - F.lag("end").over(beside) <= _GAP) & F.arrays_overlap("head", F.lag("sign").over(beside))
    met = kept.withColumn("new", F.when(meets, 0).otherwise(1)).withColumn("run", F.sum("new").over(beside))
    runs = met.groupBy("row_id", "ordinal", "place", "run").agg(
        F.first("keys").alias("keys"), F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("lead", "start").alias("lead"), F.max_by("tail", "start").alias("tail"),
        F.get(F.first("sign"), F.lit(0)).alias("word"), F.sum("n").alias("n"),
    )
    common = F.col("ordinal").isin([o for o, d in ALL.chosen(RUNS) if d.kind == "anaphora"]) & F.col("word").isin(sorted(COMMON_OPENERS))
    runs = runs.where((F.col("n") >= least) & ~F.coalesce(common, F.lit(False)))
    return runs.select("keys.*", "row_id", "ordinal", (F.col("start") + F.col("lead")).alias("start"), (F.col("end") - F.col("tail")).alias("end"), F.col("n").cast("int").alias("item_count"))


def long_texts(docs: DataFrame, whole: int = WHOLE) -> DataFrame:
    """docs of which the text is longer."""
    return docs.where(F.char_length("text") > whole)


def all_runs(docs: DataFrame, keys: list[str], whole: int = WHOLE) -> DataFrame:
    """keys, ordinal, start, end, item_count of each find of these detectors, overlaps as they are.

    Texts of at most `whole` characters are searched where they lie, without a
    shuffle; run_rows() deals longer ones over the tasks. Results don't depend on it.
    """
    here = detect.scan(docs.select(*keys, "text"), RUNS, overlaps=True, runs_up_to=whole).select(*keys, F.explode("found").alias("f"))
    columns = ["ordinal", "start", "end", "item_count"]
    return here.select(*keys, *[F.col(f"f.{c}") for c in columns]).unionByName(run_rows(long_texts(docs, whole), keys).select(*keys, *columns))
