"""Session helpers: the settings every job relies on and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# HotSpot never compiles methods above 8000 bytes of bytecode, so a larger fused stage would run interpreted.
# Past this limit Spark evaluates the stage operator by operator, with its code split into small methods.
METHOD_LIMIT = "8000"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build(app: str = "hazardflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and skew-join handling on and the web page off."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.codegen.hugeMethodLimit", METHOD_LIMIT)
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Set what results and compiled expressions depend on; all other settings stay the cluster's."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", METHOD_LIMIT)
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only a local session without that
    setting may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="hazardflow-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give iterative ML fits a checkpoint folder when the session has none yet."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoints"))
