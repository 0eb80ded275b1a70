"""Session defaults and the shared folder for written intermediates."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}


PARTITION_BYTES = 256 << 20


def build_session(
    master: str | None = None, app_name: str = "rowloom", data_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with the settings every operator is written for.

    ``data_bytes``, the size of the largest table, sets the number of shuffle
    partitions (256 MiB each); AQE merges them where less data arrives. Memory
    and cores are left to the caller through ``conf``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        # Wide aggregates: methods the JVM will not compile run slower than plain operators.
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }
    if data_bytes:
        settings["spark.sql.shuffle.partitions"] = str(max(200, min(200_000, data_bytes // PARTITION_BYTES)))
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may go without one: it gets a temporary folder
    of its own, removed when the driver ends.
    """
    configured = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder all executors share")
        path = tempfile.mkdtemp(prefix="rowloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _local_dirs[app] = path
    return _local_dirs[app]


_open_scopes: list[list[str]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This fixes the outcome of non-repeatable steps (range sampling, partition
    numbering), cuts the lineage and survives the loss of executors. Inside
    :class:`scratch` the table lives until the scope ends.
    """
    path = f"{shared_dir(df.sparkSession)}/rowloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open_scopes:
        _open_scopes[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` whose readers are all written themselves."""
    path = df._written_to
    _delete(df.sparkSession, path)
    for scope in _open_scopes:
        if path in scope:
            scope.remove(path)


class scratch:
    """A scope whose written tables are deleted at its end, but for the ones that ``keep`` hands on.

    What leaves the scope must read no other table of it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> scratch:
        _open_scopes.append([])
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, written if it is not yet, owned by the surrounding scope if there is one."""
        df = df if hasattr(df, "_written_to") else materialize(df)
        _open_scopes[-1].remove(df._written_to)
        if len(_open_scopes) > 1:
            _open_scopes[-2].append(df._written_to)
        return df

    def __exit__(self, *_: object) -> None:
        for path in _open_scopes.pop():
            _delete(self.spark, path)
        # Spark drops the shuffle files of finished steps once the driver collects their plans.
        self.spark.sparkContext._jvm.System.gc()
