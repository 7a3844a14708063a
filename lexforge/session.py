"""Sessions, and the shared folder in which jobs keep intermediate tables."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexforge")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``.

    Executors and the driver all see it. Where the setting is unset, a session
    that runs in this process alone (a local test) has a temporary folder of this
    machine; on a cluster, whose executors wouldn't see that, it is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir names no shared folder, and this cluster needs one")
        if not base:
            base = tempfile.mkdtemp(prefix="lexforge-")
        _ROOTS[app] = f"{base.rstrip('/')}/lexforge-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_drop, spark, _ROOTS[app])
        _dropped_at_stop(spark, _ROOTS[app])
    return _ROOTS[app]


def _dropped_at_stop(spark: SparkSession, root: str) -> None:
    """Has the folder deleted before the session stops, as there is no way to it afterwards."""
    stop = spark.stop

    def dropped() -> None:
        _drop(spark, root)
        stop()

    spark.stop = dropped  # of this session object only


def _drop(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended, and with it the way to the folder
        return


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    It cuts the lineage: later stages reread the files, so a lost executor
    costs only its running tasks. Its size is known to the planner, which
    then decides on broadcasts by size.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_path = path
    return found


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables of :func:`written` that nothing will read any more."""
    for own in tables:
        if path := getattr(own, "_written_path", None):
            _drop(own.sparkSession, path)


def uri(path: str) -> str:
    """A Hadoop path as a URI that pyarrow takes too."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path[len("file:"):]
    return path if "://" in path else "file://" + os.path.abspath(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
