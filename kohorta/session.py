"""Session for tests and benchmarks, and the folder that cuts long lineages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kohorta")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(CHECKPOINT_KEY, tempfile.mkdtemp(prefix="kohorta-ckpt-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a temporary one only in local mode.

    A path on a machine's own disk is refused on a cluster: other machines would not see it.
    """
    local = spark.sparkContext.master.startswith("local")
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not local and (not folder or folder.startswith("file:")):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="kohorta-ckpt-")
        spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def run_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it is deleted when the driver ends.

    What is written there is read lazily, so it has to stay for as long as a result may be.
    """
    context = spark.sparkContext
    path = f"{checkpoint_dir(spark).rstrip('/')}/kohorta-{context.applicationId}"
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(folder):
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Iterative operators use this instead of a cache: the rows outlive any executor, the plan of
    the next round starts at a file scan, and the scan brings fresh size statistics for joins.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table given in code.

    Built from Arrow it is a local relation, whose size Catalyst knows; built from a list of rows it
    would be an RDD of unknown size, and joins with it would shuffle both sides.
    """
    names = [field.strip().split(" ")[0] for field in schema.split(",")]
    return spark.createDataFrame(pa.table({n: list(c) for n, c in zip(names, zip(*rows))}), schema)
