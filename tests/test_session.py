import time

from pyspark.sql import functions as F

from aerolens.session import CLEANUP, drop_written, exists, written


def shuffle_files(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("/shuffle_")


def test_a_write_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    df = spark.range(5000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("s")).repartitionByRange(3, "s")
    table = written(df, "session-test")
    for _ in range(100):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before and spark.conf.get(CLEANUP, None) == setting
    assert table.agg(F.sum("s")).first()[0] == sum(range(5000)) == df.agg(F.sum("s")).first()[0]


def test_dropped_tables_are_gone(spark):
    a, b = written(spark.range(10), "session-test"), written(spark.range(0), "session-test")
    path = a.inputFiles()[0].rsplit("/", 1)[0]
    drop_written(a, b)
    assert not exists(spark, path)
