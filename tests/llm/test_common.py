import glob
import time

from pyspark.sql import functions as F

from vectrail.llm import common


def test_written_tables_leave_no_shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    held = lambda: {f for d in blocks for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = held()
    table = common.write_table(spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count(), "counted")
    end = time.time() + 10
    while held() - before and time.time() < end:  # they are removed beside the next jobs
        time.sleep(0.1)
    assert not held() - before
    assert (table.count(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")) == (5000, "false")


def test_a_table_in_parts(spark):
    rows = spark.range(100)
    table = common.write_in_parts(lambda k: rows.where(F.col("id") % 3 == k), "parts", 3)
    assert sorted(r.id for r in table.collect()) == list(range(100))
    common.drop_table(table)
