import time
from pathlib import Path

from pyspark.sql import functions as F

from endpointlens.llm import simhash_vptree as sv
from endpointlens.llm.common import SHUFFLES_GO, store


def shuffled(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {str(p) for folder in folders for p in Path(folder.getPath()).rglob("shuffle_*")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before, setting = shuffled(spark), spark.conf.get(SHUFFLES_GO)
    kept = store(spark.range(50_000).groupBy(F.xxhash64("id").alias("k")).agg(F.count(F.lit(1)).alias("n")))
    end = time.monotonic() + 10
    while (left := shuffled(spark) - before) and time.monotonic() < end:
        time.sleep(0.2)
    assert not left and spark.conf.get(SHUFFLES_GO) == setting
    assert kept.agg(F.sum("n")).first()[0] == 50_000


def test_repeated_rows_share_no_more_tokens(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text + " tail"), (2, text + " tail"), (3, "some other words that nothing shares"), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in sv.one_of_each(docs).collect()) == [1, 3]
