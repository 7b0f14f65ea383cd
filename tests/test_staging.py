"""What is staged is read in tasks of bounded rows."""

from pyspark.sql import functions as F

from wideframe import session


def test_tasks_of_staged_rows_are_bounded(spark):
    """A million rows that hardly take any bytes come back in several files and tasks, all of them once."""
    session.prepare(spark)
    back = session.stage(spark.range(1_000_000).coalesce(1), "rows")
    per_file = back.groupBy(F.input_file_name().alias("file")).count().agg(F.max("count"), F.sum("count")).first()
    assert per_file[0] <= session.ROWS_PER_FILE and per_file[1] == 1_000_000
    per_task = back.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]
    assert per_task <= 2 * session.ROWS_PER_FILE
