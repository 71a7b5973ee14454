"""Session settings and lineage cutting."""

import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
#: Shuffled bytes that a task reads at most where the session names no size: rows of telemetry shrink
#: to a tenth of their size in a shuffle, so a task's memory is many times this.
TASK_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the plans rely on; all of them can be changed at run time.

    Arrow functions and stateful processors travel by value, so neither executors nor the
    driver's own Python workers need this package installed.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if spark.conf.get(TASK_BYTES[0], None) is None:
        spark.conf.set(*TASK_BYTES)
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by `spark.checkpoint.dir`.

    Only a local master may fall back to a folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="endpointlens-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a lost executor never restarts a whole iteration."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of this package's own below the shared one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
