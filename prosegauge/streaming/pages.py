"""Page versions as a stream: scans settle after changes, the newest version of a page counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from prosegauge.operators.catalog import ALL
from prosegauge.operators.detect import FOUND, resolved
from prosegauge.operators.grade import grade
from prosegauge.operators.page_scan import scan_pages
from prosegauge.sources.pages import allowed

VERSIONS = "page_id long, version_ts timestamp, url string, html string"


def versions(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream of the Parquet files of page versions at path."""
    return spark.readStream.schema(VERSIONS).options(**options).parquet(path)


#: The setting that merges a page's bursts within a task before they are shuffled; worth setting where versions of a page come together.
MERGE_FIRST = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def settled(stream: DataFrame, gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """The last version of each burst of changes: a page's versions less than `gap` apart are one. Later than `late`, they are dropped."""
    last = F.max_by(F.struct("url", "html", "version_ts"), "version_ts").alias("v")
    bursts = stream.withWatermark("version_ts", late).groupBy("page_id", F.session_window("version_ts", gap)).agg(last)
    return bursts.select("page_id", "v.version_ts", "v.url", "v.html")


def graded_pages(pages: DataFrame, origins: DataFrame | None = None, pattern_ids: Iterable[str] | None = None, overlaps: bool = False) -> DataFrame:
    """Pages of allowed origins (all, without origins) flattened, scanned and graded; pattern_ids and overlaps as in scan_pages()."""
    own = allowed(pages, origins) if origins is not None else pages
    return grade(scan_pages(own, pattern_ids, overlaps=overlaps)).drop("html")


def newest(rows: DataFrame) -> DataFrame:
    """One row a page: of the latest version, ties by url."""
    w = Window.partitionBy("page_id").orderBy(F.desc("version_ts"), "url")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


GRADES = f"page_id long, version_ts timestamp, url string, found {FOUND}, eligible boolean, fired_count int, tier string"
_MANIFEST = "batch long, slots array<int>, written array<long>"
#: Parts that a table of grades is dealt into by page; a batch rewrites those that it touches, so choose so many that a part is some tens of megabytes.
BUCKETS = 64
#: Folders of a bucket, written in turn: a reader has as many batches, less one, to finish.
SLOTS = 3


def upsert_grades(stream: DataFrame, table: str, checkpoint: str, origins: DataFrame | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Start a query that keeps the newest grade of each page in table, a folder all executors reach; read it with current().

    Give it settled(versions) to grade a page once its burst of changes has
    closed, or versions to grade each batch's newest. Raw finds of all
    detectors are kept, overlaps included, so that settings count when the
    table is read: a change needs no page again. One table has one checkpoint.
    """
    start = [(-1, [SLOTS - 1] * buckets, [-1] * buckets)]
    stream.sparkSession.createDataFrame(start, _MANIFEST).coalesce(1).write.mode("ignore").parquet(f"{table}/manifest/turn=0")
    write = lambda batch, batch_id: write_batch(batch, batch_id, table, origins)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_batch(batch: DataFrame, batch_id: int, table: str, origins: DataFrame | None = None) -> None:
    """Merge one micro-batch of page versions into a table of grades.

    A page's bucket follows from its id. The buckets that the batch touches are
    written whole, each to the slot after its live one; then a manifest, one
    row that names every bucket's live slot and who wrote it, takes the place
    of the one before the last. So folders and listings stay bounded by
    buckets x slots however many batches come, readers see all of a batch or
    nothing, and a batch that is run again after a failure starts from the
    manifest before it and writes the same slots.
    """
    spark, rows, staged = batch.sparkSession, f"{table}/rows", f"{table}/staged"
    last, names = _manifest(spark, table, batch_id), [f.name for f in StructType.fromDDL(GRADES)]
    bucket = F.pmod(F.xxhash64("page_id"), F.lit(len(last.slots))).cast("int").alias("bucket")
    # Written first, so that the stream's state and the scan run once, and lost executors cost no second scan.
    graded_pages(newest(batch), origins, ALL.ids, overlaps=True).select(*names, bucket).write.mode("overwrite").parquet(staged)
    graded = spark.read.schema(f"{GRADES}, bucket int").parquet(staged)
    touched = sorted(r.bucket for r in graded.select("bucket").distinct().collect())  # numbers of buckets
    if not touched:
        return
    slots, written = list(last.slots), list(last.written)
    for b in touched:
        slots[b], written[b] = (slots[b] + 1) % SLOTS, batch_id
    out = newest(graded.unionByName(_held(spark, table, last).where(F.col("bucket").isin(touched))))
    out = out.withColumns({"written": F.lit(batch_id).cast("long"), "slot": F.get(F.array(*map(F.lit, slots)), F.col("bucket"))}).repartition("bucket")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "slot").parquet(rows)
    spark.createDataFrame([(batch_id, slots, written)], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/turn={1 - last.turn}")


def _manifest(spark: SparkSession, table: str, before: int | None = None) -> Row:
    """The last manifest (of a batch before `before`): one row of two at most."""
    rows = spark.read.schema(f"{_MANIFEST}, turn int").option("ignoreMissingFiles", "true").parquet(f"{table}/manifest")
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return max(rows.collect(), key=lambda r: r.batch)


def _held(spark: SparkSession, table: str, live: Row) -> DataFrame:
    """Rows of the live slots, and their bucket. A slot that was written anew since the manifest was read is an error, not a gap."""
    schema = f"{GRADES}, written long, bucket int, slot int"
    if max(live.written) < 0:
        return spark.createDataFrame([], schema).drop("written", "slot")
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("bucket"))
    rows = spark.read.schema(schema).parquet(f"{table}/rows").where(F.col("slot") == of(live.slots))
    anew = F.raise_error(F.lit("the table of grades has changed while it was read: read it again")).cast("boolean")
    return rows.where(F.when(F.col("written") > of(live.written), anew).otherwise(F.col("written") == of(live.written))).drop("written", "slot")


def current(spark: SparkSession, table: str, pattern_ids: Iterable[str] | None = None) -> DataFrame:
    """The newest grade of each page that upsert_grades() has written, with found (resolved among pattern_ids, by default those on by default) and n_matches."""
    on = [i for i, _ in ALL.chosen(pattern_ids)]
    rows = _held(spark, table, _manifest(spark, table)).drop("bucket")
    return rows.withColumn("found", resolved(F.filter("found", lambda f: f["ordinal"].isin(on)))).withColumn("n_matches", F.size("found"))


def monitor(stream: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Pages, matches and fired signals by window of version_ts; rows later than `late` are dropped. No slide: tumbling."""
    at = F.window("version_ts", width, slide) if slide else F.window("version_ts", width)
    graded = graded_pages(stream.withWatermark("version_ts", late))
    sums = graded.groupBy(at.alias("w")).agg(F.count("*").alias("n_pages"), F.sum("n_matches").alias("n_matches"), F.sum("fired_count").alias("fired"))
    return sums.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_pages", "n_matches", "fired")


def pattern_monitor(stream: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Hits of each detector, and pages with one, by window of version_ts; a detector without hits in a window has no row there."""
    at = F.window("version_ts", width, slide) if slide else F.window("version_ts", width)
    scanned = scan_pages(stream.withWatermark("version_ts", late))
    ids = F.array(*map(F.lit, ALL.ids))
    own = F.transform(F.array_distinct(F.transform("found", lambda m: m["ordinal"])), lambda i: F.struct(F.get(ids, i).alias("pattern_id"), F.size(F.filter("found", lambda m: m["ordinal"] == i)).alias("n")))
    rows = scanned.select("version_ts", F.explode(own).alias("c"))
    sums = rows.groupBy(at.alias("w"), "c.pattern_id").agg(F.sum("c.n").alias("hits"), F.count("*").alias("n_pages"))
    return sums.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "pattern_id", "hits", "n_pages")
