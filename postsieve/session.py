"""Session settings and the shared working folder."""

from __future__ import annotations

import pathlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. Sizes (executors, memory, shuffle width) belong
# to the cluster and are left alone.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # State of streams may outgrow the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Ranks up to this are cut in every map task, before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
    # A repeated key in a reply takes its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        root = pathlib.Path(__file__).resolve().parent
        base = pathlib.Path(tempfile.mkdtemp(prefix="run-")) / root.name
        context.addPyFile(shutil.make_archive(str(base), "zip", root.parent, root.name))


def configure(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "postsieve", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster such a
    folder would vanish with the machine that holds it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return context.getCheckpointDir().rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh, unused path in the shared folder, under one folder per application.

    What an application leaves there is scratch once it has ended.
    """
    return f"{shared_dir(spark)}/postsieve-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage and pins results that a recomputation could draw differently,
    such as sampled range bounds; survives the loss of any executor.
    """
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
