"""Session defaults and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


def build_session(master: str = "local[*]", app: str = "framescope", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder all executors can reach: the one ``spark.checkpoint.dir`` names.

    Only a local master may fall back to a temporary folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/") + "/framescope"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="framescope-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the scratch root."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once and read it back: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Scan tasks a core from which their sizes even out.
EVEN_TASKS = 3


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores, to the end, on inputs of few scan tasks.

    Text scoring is CPU bound, and a file with one row group is one scan task, however many splits it has. When
    the scan gives fewer partitions than ``EVEN_TASKS`` a core, the last ones would leave cores idle, so rows are
    hashed on their key to full rounds of even tasks; larger inputs already have enough scan partitions and are
    left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.rdd.getNumPartitions()
    if parts >= EVEN_TASKS * cores:
        return df
    return df.repartition(max(1, -(-parts // cores)) * cores, key)
