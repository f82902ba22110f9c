"""A Python worker holds few rows at once."""

from prosegauge.sources.tables import BATCH_ROWS, table


def test_workers_get_few_rows(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    table(spark, str(tmp_path), "documents")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS
