import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import common, suffixes


def shuffles(spark):
    """Bytes of the shuffle files on disk, by name."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_")}


def left(spark, before, most=0):
    """Bytes of shuffle files that are newer than ``before``; Spark removes them a moment after an execution."""
    for _ in range(40):
        now = sum(n for name, n in shuffles(spark).items() if name not in before)
        if now <= most:
            break
        time.sleep(0.1)
    return now


def test_shuffle_files_of_a_written_table_go_with_the_write(spark):
    was = spark.conf.get(common._SHUFFLES_GO, None)
    before = shuffles(spark)
    df = spark.range(20_000).groupBy((F.col("id") % 7000).alias("k")).agg(F.sum("id").alias("s"))
    tables = [common.written(df, "test"), common.written(df, "test")]  # the same DataFrame again, whose shuffle is another
    assert left(spark, before) == 0
    assert [t.agg(F.count("*"), F.sum("s")).first() for t in tables] == [(7000, 20_000 * 19_999 // 2)] * 2
    assert spark.conf.get(common._SHUFFLES_GO, None) == was


def test_a_failed_write_puts_the_setting_back(spark):
    was = spark.conf.get(common._SHUFFLES_GO, None)
    with pytest.raises(Exception, match="no such row"):
        common.written(spark.range(3).select(F.raise_error(F.lit("no such row")).alias("x")), "test")
    assert spark.conf.get(common._SHUFFLES_GO, None) == was


@pytest.fixture
def no_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cutting_repeats_leaves_no_texts_in_shuffle_files(spark, no_broadcasts):
    """What the steps before the last one shuffle, texts among it, is gone when the last one begins."""
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400))
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(3000)) for _ in range(200)]
    rows = [(i, t[:1500] + passage + t[1500:]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = shuffles(spark)
    found = suffixes.without_repeats(docs)
    assert left(spark, before, 100_000) < 100_000  # the texts have 680,000 bytes
    assert all(passage not in r.text and len(r.text) <= 3000 for r in found.collect())
