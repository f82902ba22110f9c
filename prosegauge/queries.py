"""The registered queries over documents, pages and conversations, and the SQL that states them where SQL can."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.jobs import corpus
from prosegauge.operators import catalog, detect, grade
from prosegauge.operators.catalog import TIC, Detector
from prosegauge.operators.page_scan import node_rows, scan_pages
from prosegauge.operators.runs import RUNS, WHOLE, all_runs, long_texts, run_rows
from prosegauge.oracle import found_ctes, graded_ctes, windows_ctes
from prosegauge.oracle_pages import flat_ctes, seeded_html_sql
from prosegauge.sources import pages
from prosegauge.sources.seeds import HTML, seeded, seeded_html, seeded_sql
from prosegauge.sources.tables import small_batches, table
from prosegauge.streaming import pages as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PLAIN = [d.pattern_id for d in catalog.DETECTORS if catalog.sql_can_state(d.pattern_id)]


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(table(spark, sf_dir, "documents"))


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded_html(table(spark, sf_dir, "pages"))


def flat_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(pages.flatten(web_pages(spark, sf_dir)), "page_id")


def shared(spark: SparkSession, name: str) -> str:
    """A new folder that all executors reach; a local session without one gets a temporary folder."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        if not local:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="spark-prosegauge-")
    return f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df from a table in the shared folder: read more than once, worked out once."""
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SEEDED = f"SELECT doc_id AS k, text AS t FROM ({seeded_sql()})"
_MATCHES = f"WITH {found_ctes(_SEEDED)}"
_DOCS = f"docs AS (SELECT *, len(regexp_extract_all(text, '\\S+')) AS n_words FROM ({seeded_sql()}))"


@query
def pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each plain detector finds by itself: spans, documents, characters."""
    return _hits(detect.scan(documents(spark, sf_dir), PLAIN, overlaps=True))


def _hits(found: DataFrame) -> DataFrame:
    """By detector, exactly: a document is one row a detector, summed in its task first."""
    names = F.array(*map(F.lit, catalog.ALL.ids))
    own = F.transform(F.array_distinct(F.transform("found", lambda m: m["ordinal"])), lambda i: F.struct(i.alias("i"), F.filter("found", lambda m: m["ordinal"] == i).alias("f")))
    rows = found.select(F.explode(own).alias("d"))
    chars = F.aggregate("d.f", F.lit(0).cast("long"), lambda a, m: a + m["end"] - m["start"])
    return rows.groupBy(F.get(names, F.col("d.i")).alias("pattern_id")).agg(F.sum(F.size("d.f")).alias("hits"), F.count("*").alias("docs"), F.sum(chars).alias("n_chars"))


_HITS = "SELECT pattern_id, count(*) AS hits, count(DISTINCT k) AS docs, CAST(sum(e - s) AS BIGINT) AS n_chars FROM spans JOIN cat USING (o) GROUP BY pattern_id"
ORACLE_SQL["pattern_hits"] = f"WITH {found_ctes(_SEEDED, PLAIN)} {_HITS}"


@query
def every_pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of all 63 detectors, those that are off by default too; runs of sentences of huge texts come from sentence rows."""
    docs = documents(spark, sf_dir)
    found = _hits(detect.scan(docs, catalog.ALL.ids, overlaps=True, runs_up_to=WHOLE))
    runs = run_rows(long_texts(docs), ["doc_id"]).groupBy("row_id", "ordinal").agg(F.count("*").alias("hits"), F.sum(F.col("end") - F.col("start")).alias("n_chars"))
    runs = runs.groupBy(F.get(F.array(*map(F.lit, catalog.ALL.ids)), F.col("ordinal")).alias("pattern_id")).agg(F.sum("hits").alias("hits"), F.count("*").alias("docs"), F.sum("n_chars").alias("n_chars"))
    return found.unionByName(runs).groupBy("pattern_id").agg(*[F.sum(c).alias(c) for c in ("hits", "docs", "n_chars")])


ORACLE_SQL["every_pattern_hits"] = f"WITH {found_ctes(_SEEDED, catalog.ALL.ids)} {_HITS}"


@query
def sentence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of sentences that echo, begin alike or are very short, overlaps included; huge texts are dealt over the tasks."""
    runs = all_runs(documents(spark, sf_dir), ["doc_id"])
    return runs.select("doc_id", F.get(F.array(*map(F.lit, catalog.ALL.ids)), F.col("ordinal")).alias("pattern_id"), "start", "end", "item_count")


ORACLE_SQL["sentence_runs"] = f'WITH {found_ctes(_SEEDED, RUNS)} SELECT k AS doc_id, pattern_id, s AS start, e AS "end", n AS item_count FROM spans JOIN cat USING (o)'


@query
def plain_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of the plain detectors, overlaps resolved."""
    return detect.match_rows(detect.scan(documents(spark, sf_dir), PLAIN), ["doc_id"]).drop("item_count")


ORACLE_SQL["plain_matches"] = f'WITH {found_ctes(_SEEDED, PLAIN)} SELECT kept.k AS doc_id, match_id, pattern_id, s AS start, e AS "end", substring(t, s + 1, e - s) AS snippet FROM kept JOIN cat USING (o) JOIN src ON kept.k = src.k'


@query
def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of every default detector, overlaps resolved, with its label."""
    return corpus.match_table(documents(spark, sf_dir).select("doc_id", "lang", "source", "text")).drop("more_url", "description", "name", "counted", "ordinal")


_COUNTED = "CASE pattern_id " + " ".join(f"WHEN '{d.pattern_id}' THEN '{catalog.COUNTED[d.kind]}'" for d in catalog.DETECTORS if d.kind in catalog.COUNTED) + " END"
_COLUMNS = """pattern_id, s AS start, e AS "end", n AS item_count"""
ORACLE_SQL["matches"] = f"""{_MATCHES}, {_DOCS}
SELECT doc_id, lang, source, match_id, {_COLUMNS}, substring(text, s + 1, e - s) AS snippet, grp AS "group", grp = 'wiki' AS is_wiki, pattern_id <> 'colon-triple' AS default_enabled,
  replace(pattern_id, '-', ' ') || CASE WHEN n IS NULL THEN '' ELSE ' · ' || n || ' ' || {_COUNTED} END AS label
FROM kept JOIN cat USING (o) JOIN docs ON docs.doc_id = kept.k"""


@query
def disabled_group_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of what is left when the tics are switched off and colon-triple on: a settings table, taken from the catalogue."""
    off = catalog.catalog(spark).where(f"group = '{TIC}' AND pattern_id <> 'colon-triple'").select("pattern_id")
    return detect.match_rows(detect.scan(documents(spark, sf_dir), detect.ids_of(catalog.enabled(spark, off))), ["doc_id"]).drop("snippet")


_WIKI_ON = [d.pattern_id for d in catalog.DETECTORS if d.group != TIC or d.pattern_id == "colon-triple"]
ORACLE_SQL["disabled_group_matches"] = f"WITH {found_ctes(_SEEDED, _WIKI_ON)} SELECT k AS doc_id, match_id, {_COLUMNS} FROM kept JOIN cat USING (o)"


@query
def document_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of matches of every detector, zeros included."""
    maps = detect.per_pattern(detect.scan(documents(spark, sf_dir)), ["doc_id"])
    return maps.select("doc_id", F.explode("per_pattern").alias("pattern_id", "hits"))


ORACLE_SQL["document_patterns"] = f"{_MATCHES} SELECT src.k AS doc_id, pattern_id, CAST(count(kept.k) AS INTEGER) AS hits FROM src CROSS JOIN cat LEFT JOIN kept ON kept.k = src.k AND kept.o = cat.o GROUP BY ALL"


def _counts_sql(by: str) -> str:
    return f"""{_MATCHES}, {_DOCS}, total AS (SELECT {by}, count(*) AS n_docs, CAST(sum(n_words) AS BIGINT) AS n_words FROM docs GROUP BY {by}),
own AS (SELECT {by}, o, count(*) AS hits, count(DISTINCT doc_id) AS docs_hit FROM kept JOIN docs ON docs.doc_id = kept.k GROUP BY {by}, o),
counted AS (SELECT total.{by}, grp AS "group", pattern_id, n_docs, n_words, coalesce(hits, 0) AS hits, coalesce(docs_hit, 0) AS docs_hit, round(coalesce(hits, 0) * 1000 / n_words, 6) AS hits_per_1k_words
  FROM total CROSS JOIN cat LEFT JOIN own ON own.{by} IS NOT DISTINCT FROM total.{by} AND own.o = cat.o)"""


@query
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by language and detector, zeros included."""
    return corpus.counts(documents(spark, sf_dir), ["lang"])


ORACLE_SQL["corpus_counts"] = f"{_counts_sql('lang')} SELECT * FROM counted"


@query
def pattern_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and documents with hits by group and detector, with subtotals."""
    return corpus.rollup(detect.scan(documents(spark, sf_dir)))


ORACLE_SQL["pattern_rollup"] = f'{_MATCHES} SELECT grp AS "group", pattern_id, count(*) AS hits, count(DISTINCT k) AS docs FROM kept JOIN cat USING (o) GROUP BY ROLLUP (grp, pattern_id)'


@query
def top_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five detectors that find most in each source."""
    return corpus.top_patterns(corpus.counts(documents(spark, sf_dir), ["source"]), ["source"])


ORACLE_SQL["top_patterns"] = f"{_counts_sql('source')}, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY hits DESC, pattern_id) AS INTEGER) AS rank FROM counted WHERE hits > 0) SELECT * FROM ranked WHERE rank <= 5"


@query
def densest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty documents with most matches per thousand words."""
    return corpus.densest(detect.scan(documents(spark, sf_dir)))


_PER_DOC = f"{_MATCHES}, {_DOCS}, per AS (SELECT doc_id, n_words, CAST(count(o) AS INTEGER) AS n_matches, CAST(count(*) FILTER (WHERE grp = 'wiki') AS INTEGER) AS n_wiki FROM docs LEFT JOIN (SELECT k, o, grp FROM kept JOIN cat USING (o)) m ON m.k = doc_id GROUP BY doc_id, n_words)"
ORACLE_SQL["densest_documents"] = f"{_PER_DOC} SELECT doc_id, n_matches, round(n_matches * 1000 / n_words, 6) AS per_1k_words FROM per WHERE n_words > 0 ORDER BY 3 DESC, 1 LIMIT 20"


@query
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's matches of either group, its total, and whether it was cut."""
    found = detect.scan(documents(spark, sf_dir))
    return corpus.group_split(found, ["doc_id", "n_matches", "truncated"])


ORACLE_SQL["group_split"] = f"{_PER_DOC} SELECT doc_id, n_matches, false AS truncated, n_matches - n_wiki AS n_tic, n_wiki FROM per"


@query
def capped_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches in each document's first 2,000 characters, as a user asks for them who wants no more read, and whether it is longer."""
    found = detect.scan(documents(spark, sf_dir), cap=2000)
    return corpus.group_split(found, ["doc_id", "n_matches", "truncated"])


ORACLE_SQL["capped_matches"] = f"""WITH {found_ctes(f"SELECT k, substring(t, 1, 2000) AS t FROM ({_SEEDED})")}, whole AS ({_SEEDED}),
per AS (SELECT k, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (WHERE grp = 'wiki') AS INTEGER) AS n_wiki FROM kept JOIN cat USING (o) GROUP BY k)
SELECT k AS doc_id, coalesce(n, 0) AS n_matches, length(t) > 2000 AS truncated, coalesce(n - n_wiki, 0) AS n_tic, coalesce(n_wiki, 0) AS n_wiki FROM whole LEFT JOIN per USING (k)"""


@query
def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword-in-context extracts of all matches."""
    return detect.contexts(documents(spark, sf_dir), ["doc_id"])


ORACLE_SQL["contexts"] = f'{_MATCHES}, {windows_ctes()} SELECT k AS doc_id, window_id, s AS start, e AS "end", n_regions, n_matches, text AS context FROM context'


@query
def match_at_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match that covers the tenth character from the end of each document, if one does."""
    docs = documents(spark, sf_dir)
    rows = detect.match_rows(detect.scan(docs), ["doc_id"])
    return detect.matches_at(docs.select("doc_id", (F.char_length("text") - 10).alias("pos")), rows)


ORACLE_SQL["match_at_middle"] = f'{_MATCHES}, probes AS (SELECT k AS doc_id, CAST(length(t) - 10 AS INTEGER) AS pos FROM src) SELECT doc_id, pos, match_id, pattern_id, s AS start, e AS "end" FROM probes LEFT JOIN (kept JOIN cat USING (o)) ON k = doc_id AND pos >= s AND pos < e'


@query
def user_detector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by language of two detectors that a user adds, a phrase and a function, beside three built-in ones that they compete with."""

    def shouted(text: str):
        at = 0
        for word in text.split(" "):
            if len(word) >= 4 and word.isascii() and word.isalpha() and word.isupper():
                yield at, at + len(word), None
            at += len(word) + 1

    own = catalog.ALL.added(Detector("rest-of-it", "own", "the whole idea or list", specs=("the whole (idea|list)",)), Detector("shouted", "own", "words in capitals", "function", function=shouted))
    counted = corpus.counts(documents(spark, sf_dir), ["lang"], ["whole", "is-the-whole", "rest-of-it", "shouted"], own)
    return counted.where("group = 'own' OR pattern_id IN ('whole', 'is-the-whole')").select("lang", "pattern_id", "hits", "docs_hit")


_LOUD = "list_filter(string_split(t, ' '), lambda w: regexp_full_match(w, '[A-Z]{4,}'))"
ORACLE_SQL["user_detector_counts"] = f"""WITH {found_ctes(_SEEDED, ["whole", "is-the-whole"])}, {_DOCS},
own AS (SELECT k, pattern_id, count(*) AS n FROM kept JOIN cat USING (o) GROUP BY ALL
  UNION ALL SELECT k, 'shouted', len({_LOUD}) FROM src WHERE len({_LOUD}) > 0)
SELECT l.lang, p.pattern_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS hits, count(own.k) AS docs_hit
FROM (SELECT DISTINCT lang FROM docs) l CROSS JOIN (VALUES ('whole'), ('is-the-whole'), ('rest-of-it'), ('shouted')) p(pattern_id)
  LEFT JOIN (own JOIN docs ON docs.doc_id = own.k) ON docs.lang IS NOT DISTINCT FROM l.lang AND own.pattern_id = p.pattern_id GROUP BY ALL"""


@query
def match_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches written in folders by group and language, and what reading them back gives of one group."""
    path = shared(spark, "matches")
    corpus.write_matches(corpus.match_table(documents(spark, sf_dir).select("doc_id", "lang", "text")), path)
    return spark.read.parquet(path).where("group = 'wiki'").groupBy("lang", "pattern_id").agg(F.count("*").alias("hits"))


ORACLE_SQL["match_sink"] = f"{_MATCHES}, {_DOCS} SELECT lang, pattern_id, count(*) AS hits FROM kept JOIN cat USING (o) JOIN docs ON docs.doc_id = kept.k WHERE grp = 'wiki' GROUP BY ALL"

_GRADES = f"WITH {graded_ctes(_SEEDED)}"


@query
def signal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value, firing, label and display of every signal of every eligible document; of its list items, numbers that follow from its id."""
    docs = documents(spark, sf_dir).withColumns({"li_total": F.pmod("doc_id", F.lit(9)).cast("int"), "li_bold": F.pmod("doc_id", F.lit(4)).cast("int")})
    rows = grade.signal_rows(grade.grade(docs.withColumn("li_bold", F.least("li_bold", "li_total"))), ["doc_id", "n_words", "n_sentences"])
    return rows.select("doc_id", "n_words", "n_sentences", "key", "label", "applicable", "fired", F.round("value", 6).alias("value"), "display")


_LABELS = "CASE key " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in grade.LABELS.items()) + " END"
#: Halves are rounded up before they are printed.
_TENTH, _PERCENT = "printf('%.1f in 1,000 words', floor(value * 10 + 0.5) / 10)", "CAST(floor(value * 100 + 0.5) AS INTEGER)"
ORACLE_SQL["signal_values"] = f"""WITH {graded_ctes(_SEEDED, "k % 9", "least(k % 4, k % 9)")}
SELECT s.k AS doc_id, g.n_words, g.n_sentences, key, {_LABELS} AS label, applicable, fired, round(value, 6) AS value,
  CASE WHEN NOT applicable THEN 'doesn''t apply' WHEN key IN ('burstiness', 'para-uniform') THEN printf('variation %.2f', floor(value * 100 + 0.5) / 100)
    WHEN key IN ('transitions', 'expletives') THEN {_PERCENT} || '% of the sentences' WHEN key = 'em-dash' THEN {_TENTH} WHEN key = 'rule-of-three' THEN z.triads || ' triads, ' || {_TENTH}
    WHEN key = 'antithesis' THEN z.contrasts || ' contrasts, ' || {_TENTH} WHEN key = 'typography' THEN CAST(value AS INTEGER) || ' of 3 signs' ELSE {_PERCENT} || '% of ' || z.li_total || ' items' END AS display
FROM signals s JOIN graded g USING (k) JOIN sized z USING (k)"""


@query
def document_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's grade and badge."""
    graded = grade.grade(documents(spark, sf_dir))
    return graded.select("doc_id", "eligible", "n_words", "n_sentences", "applicable_count", "fired_count", "tier", F.col("badge.text").alias("badge"))


ORACLE_SQL["document_grades"] = f"{_GRADES} SELECT k AS doc_id, * EXCLUDE (k), CASE WHEN eligible THEN CAST(fired_count AS VARCHAR) END AS badge FROM graded"


@query
def tier_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language, source, eligibility and tier."""
    return corpus.tiers(grade.grade(documents(spark, sf_dir)), ["lang", "source"])


ORACLE_SQL["tier_histogram"] = f"{_GRADES} SELECT lang, source, eligible, tier, count(*) AS n_docs, CAST(sum(fired_count) AS BIGINT) AS fired FROM graded JOIN documents d ON d.doc_id = k GROUP BY ALL"


@query
def tier_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible documents of each source, one column a tier."""
    return corpus.tier_table(grade.grade(documents(spark, sf_dir)), ["source"])


ORACLE_SQL["tier_table"] = f"{_GRADES} SELECT source, " + ", ".join(f"count(*) FILTER (WHERE tier = '{t}') AS {t}" for t in ("low", "some", "elevated", "high")) + " FROM graded JOIN documents d ON d.doc_id = k WHERE eligible GROUP BY source"


@query
def signal_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each signal applies and fires, by language."""
    return corpus.signal_rates(grade.grade(documents(spark, sf_dir)), ["lang"])


ORACLE_SQL["signal_rates"] = f"{_GRADES} SELECT lang, key, count(*) AS n_docs, count(*) FILTER (WHERE applicable) AS applicable, count(*) FILTER (WHERE fired) AS fired FROM signals JOIN documents d ON d.doc_id = k GROUP BY ALL"


@query
def signal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of signals that fire together."""
    return corpus.cofiring(grade.grade(documents(spark, sf_dir)))


ORACLE_SQL["signal_pairs"] = f"{_GRADES} SELECT a.key AS key_a, b.key AS key_b, count(*) AS n_docs FROM signals a JOIN signals b ON a.k = b.k AND a.key < b.key WHERE a.fired AND b.fired GROUP BY ALL"


@query
def quality_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents by quality and tier, with subtotals."""
    return corpus.by_quality(grade.grade(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL["quality_cube"] = f"{_GRADES} SELECT quality, tier, count(*) AS n_docs FROM graded JOIN labels l ON l.doc_id = k GROUP BY CUBE (quality, tier)"


@query
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents but those whose grade is some or more."""
    return corpus.clean(grade.grade(documents(spark, sf_dir)), ["doc_id", "lang", "source"], ("some", "elevated", "high"))


ORACLE_SQL["clean_documents"] = f"{_GRADES} SELECT d.doc_id, d.lang, d.source FROM graded JOIN documents d ON d.doc_id = k WHERE tier = 'low'"


@query
def grade_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades written in folders by tier and language, and what reading them back gives of the tiers above low."""
    path = shared(spark, "grades")
    corpus.write_grades(grade.grade(documents(spark, sf_dir).select("doc_id", "lang", "text")), path)
    return spark.read.parquet(path).where("tier <> 'low'").groupBy("tier", "lang").agg(F.count("*").alias("n_docs"), F.max("fired_count").alias("most"))


ORACLE_SQL["grade_sink"] = f"{_GRADES} SELECT tier, lang, count(*) AS n_docs, max(fired_count) AS most FROM graded JOIN documents d ON d.doc_id = k WHERE tier <> 'low' GROUP BY ALL"


@query
def role_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An assistant's manners and leftovers by role, over conversations."""
    return corpus.by_role(seeded(table(spark, sf_dir, "conversations"), "conv_id"))


ORACLE_SQL["role_hits"] = f"""WITH turns AS (SELECT *, row_number() OVER () AS k FROM ({seeded_sql('conversations', 'conv_id')})),
{found_ctes('SELECT k, text AS t FROM turns', ['chat-boilerplate', 'ai-leftovers'])},
total AS (SELECT role, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS n_words FROM turns GROUP BY role),
own AS (SELECT role, o, count(*) AS hits, count(DISTINCT k) AS docs_hit FROM kept JOIN turns USING (k) GROUP BY role, o)
SELECT total.role, grp AS "group", pattern_id, n_docs, n_words, coalesce(hits, 0) AS hits, coalesce(docs_hit, 0) AS docs_hit, round(coalesce(hits, 0) * 1000 / n_words, 6) AS hits_per_1k_words
FROM total CROSS JOIN (SELECT * FROM cat WHERE pattern_id IN ('chat-boilerplate', 'ai-leftovers')) cat LEFT JOIN own ON own.role IS NOT DISTINCT FROM total.role AND own.o = cat.o"""


@query
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origin, scannability and normal form of every page's URL."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", pages.scannable(u).alias("scannable"), pages.origin(u).alias("origin"), pages.normalised(u).alias("normal_url"))


ORACLE_SQL["page_urls"] = r"""
SELECT page_id, coalesce(regexp_matches(url, '(?i)\Ahttps?:'), false) AS scannable,
  CASE WHEN regexp_matches(url, '(?i)\Ahttps?://[^/?#]') THEN
    lower(regexp_extract(url, '(?i)\A(https?)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '(?i)\Ahttps?://(?:[^/?#@]*@)?([^/?#]+)', 1)), CASE WHEN lower(url) LIKE 'https%' THEN ':443\z' ELSE ':80\z' END, '') END AS origin,
  CASE WHEN regexp_matches(trim(url), '(?i)\Ahttps?://') THEN trim(url)
       WHEN regexp_matches(trim(url), '(?i)\A[\w.-]+\.[a-z]{2,}(?:[/:?#]|\z)') THEN 'https://' || trim(url) ELSE '' END AS normal_url
FROM pages
"""


@query
def origin_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of flattened pages by origin."""
    own = flat_pages(spark, sf_dir).withColumn("origin", pages.origin(F.col("url")))
    return corpus.tiers(grade.grade(own), ["origin"])


_PAGES = flat_ctes(f"SELECT page_id AS id, html FROM ({seeded_html_sql()})")
_LISTED = tuple(f"(SELECT f.{x} FROM flat f WHERE f.id = k)" for x in ("li_total", "li_bold"))
ORACLE_SQL["origin_tiers"] = f"""WITH {_PAGES}, urls AS ({ORACLE_SQL["page_urls"]}), prose AS ({seeded_sql("(SELECT id, t AS text FROM flat)", "id")}),
{graded_ctes("SELECT id AS k, text AS t FROM prose", *_LISTED)}
SELECT origin, eligible, tier, count(*) AS n_docs, CAST(sum(fired_count) AS BIGINT) AS fired FROM graded JOIN urls ON page_id = k GROUP BY ALL"""


@query
def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each page's visible text, its nodes, and its list items."""
    flat = pages.flatten(web_pages(spark, sf_dir))
    return flat.select("page_id", F.char_length("text").alias("n_chars"), F.size("segments").alias("n_segments"), "li_total", "li_bold")


ORACLE_SQL["page_lists"] = f"WITH {_PAGES} SELECT id AS page_id, n_chars, n_segments, li_total, li_bold FROM flat"


@query
def page_match_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text nodes in which each match of a page begins and ends."""
    own = web_pages(spark, sf_dir).where(pages.scannable(F.col("url")))
    return node_rows(scan_pages(own), ["page_id"])


ORACLE_SQL["page_match_nodes"] = f"""WITH {_PAGES}, {found_ctes("SELECT id AS k, t FROM flat JOIN pages ON page_id = id WHERE regexp_matches(url, '(?i)^https?:')")}
SELECT kept.k AS page_id, match_id, pattern_id, s AS start, e AS "end", a.seg_idx AS first_seg, s - a.buf_start AS first_at, b.seg_idx AS last_seg, e - 1 - b.buf_start AS last_at
FROM kept JOIN cat USING (o) JOIN nodes a ON a.id = k AND s >= a.buf_start AND s < a.buf_start + a.len JOIN nodes b ON b.id = k AND e - 1 >= b.buf_start AND e - 1 < b.buf_start + b.len WHERE e > s"""


@query
def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the third character of every node of a page lies in its text; -1 for the node after the last, which isn't there."""
    flat = written(pages.flatten(web_pages(spark, sf_dir)).select("page_id", "segments"), "segments")
    own = flat.select("page_id", F.explode(F.sequence(F.lit(0), F.size("segments"))).alias("seg_idx"), F.lit(3).alias("offset"))
    return pages.buffer_offsets(own, pages.segment_rows(flat, ["page_id"]))


ORACLE_SQL["segment_offsets"] = f"""WITH {_PAGES}, probes AS (SELECT id, unnest(range(0, n_segments + 1)) AS seg_idx FROM flat)
SELECT id AS page_id, CAST(seg_idx AS INTEGER) AS seg_idx, 3 AS "offset", CAST(coalesce(buf_start + least(3, len), -1) AS INTEGER) AS buf_offset FROM probes LEFT JOIN nodes USING (id, seg_idx)"""


@query
def allowed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's origin is allowed: the list has the origins of every third page."""
    own = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = own.where("page_id % 3 = 0").select(pages.origin(F.col("url")).alias("origin"))
    both = [pages.allowed(own, listed, keep).select("page_id", F.lit(keep).alias("allowed")) for keep in (True, False)]
    return both[0].unionByName(both[1])


ORACLE_SQL["allowed_pages"] = f"""WITH own AS ({ORACLE_SQL["page_urls"]})
SELECT page_id, coalesce(origin IN (SELECT origin FROM own WHERE page_id % 3 = 0 AND origin IS NOT NULL), false) AS allowed FROM own"""


#: What each version of a page begins with, and how many seconds after the first it comes: two in one burst, one later, two later still.
VERSIONS = (("", 0), ("<body><h1>Moving forward</h1>", 2), ("<body><p>It just works.</p>", 60), ("<body><p>In order to go.</p>", 300), ("<body><h1>Timing is everything.</h1>", 303))


def _versions_of(own: DataFrame, n: int) -> DataFrame:
    """The first n of VERSIONS of each page, spread over ten hours."""
    own = own.select("page_id", (F.lit(1_700_000_000) + F.col("page_id") * 977 % 36000).alias("at"), "url", "html")
    each = F.explode(F.array(*[F.struct(F.lit(head).alias("head"), F.lit(after).alias("after")) for head, after in VERSIONS[:n]]))
    return own.withColumn("v", each).select("page_id", F.timestamp_seconds(F.col("at") + F.col("v.after")).alias("version_ts"), "url", F.concat("v.head", "html").alias("html"))


def page_versions(spark: SparkSession, sf_dir: str, n: int = 2) -> str:
    """A folder of page versions."""
    path = shared(spark, "versions")
    _versions_of(web_pages(spark, sf_dir), n).write.parquet(path)
    return path


def version_stream(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """A stream of page versions, formed as pages are read, so that they are nowhere written n times."""
    small_batches(spark)
    name = f"{sf_dir}/pages.parquet"
    own = spark.readStream.schema(spark.read.parquet(name).schema).parquet(f"{name}*")  # a pattern, as the table may be one file
    return _versions_of(seeded_html(own), n)


def _versions_sql(n: int = 2) -> str:
    """CTEs: versions(id, page_id, version_s, url, html) as page_versions() writes them, and the last second of them all."""
    heads = ", ".join(f"({i}, '{head}', {after})" for i, (head, after) in enumerate(VERSIONS[:n]))
    return f"""versions AS MATERIALIZED (SELECT page_id * {n} + i AS id, page_id, 1700000000 + page_id * 977 % 36000 + after AS version_s, url, head || html AS html FROM ({seeded_html_sql()}) p CROSS JOIN (VALUES {heads}) v(i, head, after)),
ended AS (SELECT max(version_s) AS last_s FROM versions)"""


#: A CTE after flat_ctes(), of its own scope: grades(k, eligible, fired_count, tier, ...).
_FLAT_GRADES = f"grades AS MATERIALIZED (WITH {graded_ctes('SELECT id AS k, t FROM flat', *_LISTED)} SELECT * FROM graded)"


def _newest_sql(chosen: str, pattern_ids: list[str] | None = None, n: int = 2) -> str:
    """The newest of the chosen versions of each page, scanned and graded."""
    return f"""WITH {_versions_sql(n)}, newest AS (SELECT * FROM ({chosen}) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY version_s DESC) = 1),
{flat_ctes("SELECT id, html FROM newest")}, {found_ctes("SELECT id AS k, t FROM flat", pattern_ids)}, {_FLAT_GRADES},
hits AS (SELECT k, CAST(count(*) AS INTEGER) AS n FROM kept GROUP BY k)
SELECT page_id, version_s, url, coalesce(hits.n, 0) AS n_matches, eligible, fired_count, tier FROM newest JOIN grades ON grades.k = newest.id LEFT JOIN hits ON hits.k = newest.id"""


def _in_seconds(grades: DataFrame) -> DataFrame:
    return grades.select("page_id", F.unix_timestamp("version_ts").alias("version_s"), "url", "n_matches", "eligible", "fired_count", "tier")


@query
def stream_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest grade of each page, from a stream of its versions written batch by batch."""
    grades = shared(spark, "grades")
    q = stream.upsert_grades(stream.versions(spark, page_versions(spark, sf_dir)), grades, shared(spark, "state"))
    q.awaitTermination()
    return _in_seconds(stream.current(spark, grades))


ORACLE_SQL["stream_grades"] = _newest_sql("SELECT * FROM versions")


@query
def stream_settled_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grade of each page's last closed burst of changes, of three, in one query from versions to grades."""
    grades, rows = shared(spark, "grades"), version_stream(spark, sf_dir, len(VERSIONS))
    before = spark.conf.get(stream.MERGE_FIRST)
    spark.conf.set(stream.MERGE_FIRST, "true")  # a query keeps what is set when it starts
    try:
        q = stream.upsert_grades(stream.settled(rows, late="0 seconds"), grades, shared(spark, "state"))
    finally:
        spark.conf.set(stream.MERGE_FIRST, before)
    q.awaitTermination()
    return _in_seconds(stream.current(spark, grades))


_SETTLED = """SELECT id, page_id, version_s, url, html FROM (SELECT *, lead(version_s) OVER (PARTITION BY page_id ORDER BY version_s) AS next_s FROM versions), ended
  WHERE version_s + 5 <= coalesce(next_s, version_s + 5) AND version_s + 5 <= last_s"""
ORACLE_SQL["stream_settled_grades"] = _newest_sql(_SETTLED, n=len(VERSIONS))


@query
def stream_allowed_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the origins of every third page, with the wiki group switched off by a settings table after all batches: no page is read again."""
    grades, settings = shared(spark, "grades"), shared(spark, "settings")
    listed = table(spark, sf_dir, "pages").where("page_id % 3 = 0").select(pages.origin(F.col("url")).alias("origin")).where("origin IS NOT NULL")
    stream.upsert_grades(stream.versions(spark, page_versions(spark, sf_dir), maxFilesPerTrigger=2), grades, shared(spark, "state"), listed).awaitTermination()
    catalog.catalog(spark).where("is_wiki OR NOT default_enabled").select("pattern_id").write.parquet(settings)
    on = detect.ids_of(catalog.enabled(spark, spark.read.parquet(settings)))
    return _in_seconds(stream.current(spark, grades, on))


_TICS_ON = [d.pattern_id for d in catalog.DETECTORS if d.group == TIC and d.default_on]
ORACLE_SQL["stream_allowed_grades"] = _newest_sql(f"SELECT versions.* FROM versions JOIN ({ORACLE_SQL['allowed_pages']}) a USING (page_id) WHERE allowed", _TICS_ON)


def _drained(frame: DataFrame, spark: SparkSession) -> DataFrame:
    """What a stream over files gives, as a table."""
    out = shared(spark, "stream")
    frame.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", shared(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)


def _window_s(frame: DataFrame) -> DataFrame:
    """frame with its windows' edges in seconds."""
    return frame.withColumns({f"{x}_s": F.unix_timestamp(x) for x in ("window_start", "window_end")}).drop("window_start", "window_end")


@query
def stream_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, matches and signals in windows of ten minutes that the watermark has closed."""
    return _window_s(_drained(stream.monitor(stream.versions(spark, page_versions(spark, sf_dir)), late="0 seconds"), spark))


_ALL_VERSIONS = f"WITH {_versions_sql()}, {flat_ctes('SELECT id, html FROM versions')}, {found_ctes('SELECT id AS k, t FROM flat')}"
ORACLE_SQL["stream_monitor"] = f"""{_ALL_VERSIONS}, {_FLAT_GRADES},
hits AS (SELECT k, count(*) AS n FROM kept GROUP BY k)
SELECT w AS window_start_s, w + 600 AS window_end_s, count(*) AS n_pages, CAST(sum(coalesce(hits.n, 0)) AS BIGINT) AS n_matches, CAST(sum(fired_count) AS BIGINT) AS fired
FROM (SELECT *, version_s // 600 * 600 AS w FROM versions, ended) v JOIN grades ON grades.k = v.id LEFT JOIN hits ON hits.k = v.id WHERE w + 600 <= last_s GROUP BY w"""


@query
def stream_pattern_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each detector in windows of ten minutes that the watermark has closed."""
    return _window_s(_drained(stream.pattern_monitor(stream.versions(spark, page_versions(spark, sf_dir)), late="0 seconds"), spark))


@query
def stream_sliding_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in windows that begin every five minutes, so that each page counts in two."""
    return _window_s(_drained(stream.pattern_monitor(stream.versions(spark, page_versions(spark, sf_dir)), slide="5 minutes", late="0 seconds"), spark))


def _windows_sql(slide: int) -> str:
    return f"""{_ALL_VERSIONS}, in_windows AS (SELECT id, unnest(range(version_s // {slide} * {slide} - 600 + {slide}, version_s + 1, {slide})) AS w FROM versions)
SELECT w AS window_start_s, w + 600 AS window_end_s, pattern_id, count(*) AS hits, count(DISTINCT k) AS n_pages
FROM kept JOIN cat USING (o) JOIN in_windows ON in_windows.id = k, ended WHERE w + 600 <= last_s GROUP BY w, pattern_id"""


ORACLE_SQL["stream_pattern_monitor"] = _windows_sql(600)
ORACLE_SQL["stream_sliding_monitor"] = _windows_sql(300)


@query
def stream_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that each closed burst of changes settled on."""
    rows = _drained(stream.settled(stream.versions(spark, page_versions(spark, sf_dir)), late="0 seconds"), spark)
    return rows.select("page_id", F.unix_timestamp("version_ts").alias("version_s"), F.char_length("html").alias("n_chars"))


ORACLE_SQL["stream_settled"] = f"""
WITH seeded AS (SELECT page_id, html, [{", ".join(str(len(x)) for x in HTML)}][page_id % {len(HTML)} + 1] AS added FROM pages),
versions AS (SELECT page_id, 1700000000 + page_id * 977 % 36000 + 2 AS version_s, length('<body><h1>Moving forward</h1>') + length(html) + added AS n_chars FROM seeded)
SELECT * FROM versions WHERE version_s + 5 <= (SELECT max(version_s) FROM versions)
"""
