"""Session defaults and the shared working folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name="reviewloom", master=None, **conf):
    """A session with the settings the operators are tuned for.

    Everything is a default: keyword arguments (dots written as ``__``) and the
    cluster's own configuration take precedence.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    settings.update({key.replace("__", "."): str(value) for key, value in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark, label):
    """A new folder for checkpoints and intermediate tables.

    It lies under ``spark.checkpoint.dir``, which on a cluster must be reachable
    from every executor. Only a local session may run without that setting; it
    then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="reviewloom-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df, label):
    """Write a frame to a new table in the shared folder and read it from there.

    For an intermediate result that several later steps read: what it was made
    from is then scanned once, also when executors are lost later on. The shuffle files
    of the write are removed at its end, as the table stands for them.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables):
    """Remove tables made by ``stored``.

    Only for tables that no frame still to be run is made from: what is stored later
    is read from its own files, also when executors are lost.
    """
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
