"""Session factory and the few settings the plans rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Bytes of bytecode above which HotSpot leaves a method to its interpreter.
COMPILED_BYTES = 8000


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks. On a cluster, bring your own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quarry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def compiled_stages(spark: SparkSession) -> None:
    """For plans with large projections: a stage fused into a method that HotSpot would never compile runs operator by operator
    instead, whose generated code comes in small methods. Results are the same; Spark's own limit is 65,535 bytes."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(COMPILED_BYTES))


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage: the cluster's own setting. Only a local master, where driver and executors are one
    process, may do without it; it then gets a temporary folder that goes with the process."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="quarry-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def staging_path(spark: SparkSession, kind: str = "stage") -> str:
    """A folder of its own under the shared folder."""
    return f"{checkpoint_dir(spark)}/quarry-{kind}-{uuid.uuid4().hex}"


def staged(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back: several readers, one computation, and a lost
    executor costs no recomputation of what went before."""
    folder = staging_path(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove the files of staged results that nothing reads any more."""
    jvm, root = spark.sparkContext._jvm, checkpoint_dir(spark).removeprefix("file://")
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if root in folder and "/quarry-" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
