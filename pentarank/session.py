"""Session settings and lineage cutting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are written for. Shuffle width is left to the cluster:
# AQE coalesces small partitions and splits skewed join partitions.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows carry whole texts and images, so Arrow batches are bounded by bytes too.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    app_name: str = "pentarank", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share.

    A session without the setting, as in tests, gets a folder inside Spark's own warehouse. On a cluster that must
    be shared storage: a warehouse on the driver's own disk, Spark's default, is refused there. No
    machine-local temporary folder is ever used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        if not spark.sparkContext.master.startswith("local") and _on_own_disk(folder, spark):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {folder} is local to the driver")
    return folder.rstrip("/")


def _on_own_disk(folder: str, spark: SparkSession) -> bool:
    scheme = folder.partition(":")[0] if ":" in folder.partition("/")[0] else ""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return (scheme or default.partition(":")[0]) == "file"


def input_partitions(spark: SparkSession) -> int | None:
    """Tasks the caller wants inputs of heavy rows spread over; unset leaves them as scanned."""
    wanted = spark.conf.get("pentarank.inputPartitions", None)
    return int(wanted) if wanted else None


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
