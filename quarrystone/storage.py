"""Tables in the shared folder of the cluster, and reading of inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's own checkpoint folder.

    Only a local session that names neither (a test) gets a temporary folder of this machine; on a cluster, where the executors would not see it, that is refused.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    set_to = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_to.isDefined():
        return set_to.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quarrystone-")
    spark.sparkContext.setCheckpointDir(own)
    return shared_dir(spark)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quarrystone/{spark.sparkContext.applicationId}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """df as a parquet table in the shared folder, in parts by the columns of ``by``: cuts the lineage and outlives lost executors.

    The shuffle files of the write go as soon as it is done, since nothing reads them again; else they would stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, partitionBy=by)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


_KEPT: dict[tuple[str, ...], object] = {}


def kept(spark: SparkSession, *key: str, make):
    """What ``make`` gives, made once per application and key; for tables that several queries read, until drop_written."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _KEPT:
        _KEPT[full] = make()
    return _KEPT[full]


def drop_written(spark: SparkSession) -> None:
    """Removes what this application wrote, once no result that reads it is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for key in [k for k in _KEPT if k[0] == spark.sparkContext.applicationId]:
        del _KEPT[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """At least as many partitions as the session shuffles into, when the scan gave too few for a costly map.

    Columns name the rows to keep; a file that Spark can split is left alone.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    picked = df.select(*columns) if columns else df
    return picked if picked.rdd.getNumPartitions() * 2 >= want else picked.repartition(want)
