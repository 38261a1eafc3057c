import time

from pyspark.sql import functions as F

from passagemill.workspace import Workspace, saved


def shuffle_files(spark) -> set[str]:
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for k in range(found.size()) if (n := found.apply(k).getName()).startswith("shuffle_")}


def test_saved_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    with Workspace(spark) as work:
        assert work.saved(rows).count() == 7
        assert saved(work.saved(rows)).groupBy().sum("count").first()[0] == 1000
    until = time.time() + 20
    while (left := {n for n in shuffle_files(spark) - before if n.endswith(".data")}) and time.time() < until:
        time.sleep(0.2)
    # What count() and first() shuffled is theirs, a row for each task; the tables' own shuffles are gone.
    assert len(left) <= 8
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_tables_are_dropped_by_name(spark):
    with Workspace(spark) as work:
        work.saved(spark.range(3), "a-b")
        kept = work.saved(spark.range(4), "b")
        work.drop("a-b", "c")
        assert len(work.paths) == 1 and kept.count() == 4
