"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings platform_versions source_weights "
    "methods config_objects query_tables cfe_diffs cfe_patches bsl_modules context_violations"
).split()


def build_session(master: str = "local[*]", app: str = "ledgerloom", **conf: str) -> SparkSession:
    """A session with the engine's defaults; every key of ``conf`` overrides them (dots spelled as ``__``)."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables; column pruning and filters reach the scan because nothing is materialised here."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one the cluster names in ``spark.checkpoint.dir``.  Only a local session, as in
    tests, may go without; a cluster that names none is an error, for a folder of one machine would lose data there."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "ledgerloom-checkpoints")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    held = df.checkpoint(eager=True)
    # a checkpoint keeps the constraints and size estimates of the plan it cuts; in loops they double with every round, so
    # the stored rows are taken without them
    session = df.sparkSession._jsparkSession
    bare = session.internalCreateDataFrame(held._jdf.queryExecution().toRdd(), held._jdf.schema(), False)
    return DataFrame(bare, df.sparkSession)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written as a table in the shared folder: columns are read one by one, and the lineage is cut.  The
    table is removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Rows over all cores where a table has fewer parts than the cluster has cores (heavy expressions outweigh the
    exchange); larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores * per_core)
