"""Session helpers: building a local session and finding the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import weakref
from functools import wraps

from pyspark.sql import SparkSession

#: Names this driver process's folder below the shared one.
_SESSION = uuid.uuid4().hex


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "sevscope") -> SparkSession:
    """Session for tests, benches and local runs (UI off, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only when it is unset and the master is local (tests) a fresh folder is
    created; elsewhere that would scatter the rows over machines.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all "
                               "executors share; a temporary folder of one machine would lose rows")
        configured = tempfile.mkdtemp(prefix="sevscope-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path below the shared checkpoint folder (unique per call)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "sevscope", _SESSION, *parts, uuid.uuid4().hex])


#: The folder behind each staged frame, and the open scopes (inner last).
_FOLDER_OF: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_SCOPES: list = []


def stage(df, name: str, row_group: int | None = None, schema=None):
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    back: the lineage is cut (a lost executor re-reads the files instead of
    recomputing the plan) and later tasks carry only a file scan. Used before
    iterative fits and for tables several jobs reuse. One pass, unlike an
    eager ``checkpoint()`` of an unpersisted frame, which computes it twice.
    The innermost open ``Scope`` owns the table. ``row_group`` are the bytes that
    a reader holds at once, for tables of long rows; ``schema`` is what the files
    are read as, where this differs from the frame's own."""
    spark = df.sparkSession
    path = shared_path(spark, "stage", name)
    if _SCOPES:
        _SCOPES[-1].owned.append(path)
    rows = {} if row_group is None else {"parquet.block.size": row_group}
    df.write.mode("overwrite").options(compression="zstd", **rows).parquet(path)
    table = (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    _FOLDER_OF[table] = path
    return table


def is_staged(df) -> bool:
    """Whether ``stage`` returned this frame."""
    return df in _FOLDER_OF


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(*tables) -> None:
    """Delete staged tables whose last reader has been written. ``tables`` are
    frames that ``stage`` returned; others are left alone."""
    for table in tables:
        path = _FOLDER_OF.pop(table, None) if table is not None else None
        if path is not None:
            for scope in _SCOPES:
                if path in scope.owned:
                    scope.owned.remove(path)
            remove(table.sparkSession, path)


class Scope:
    """Owns the tables staged while it is open and deletes them when it closes,
    but for those that its ``result`` still reads: these pass to the scope
    around it (or stay until ``clear_staged``).

        with Scope(spark) as own:
            return own.result(query(spark, sf_dir))
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.owned, self.kept = spark, [], []

    def __enter__(self):
        _SCOPES.append(self)
        return self

    def result(self, df):
        """Keep what ``df`` reads, by the file names of its plan."""
        folders = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
        self.kept += [path for path in self.owned if path.rsplit("/", 1)[-1] in folders]
        return df

    def __exit__(self, *_):
        _SCOPES.remove(self)
        for path in self.owned:
            if path not in self.kept:
                remove(self.spark, path)
        if _SCOPES:
            _SCOPES[-1].owned += self.kept


def scoped(query):
    """A query (spark, sf_dir) -> frame that leaves only the staged tables its
    result reads."""
    @wraps(query)
    def run(spark, sf_dir):
        with Scope(spark) as own:
            return own.result(query(spark, sf_dir))
    return run


def staged_tables(spark: SparkSession) -> list[str]:
    """Folders of this session's staged tables that exist now."""
    place = spark._jvm.org.apache.hadoop.fs.Path(
        "/".join([ensure_checkpoint_dir(spark).rstrip("/"), "sevscope", _SESSION, "stage", "*", "*"]))
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return sorted(f.getPath().toString() for f in found or [])


def clear_staged(spark: SparkSession) -> None:
    """Delete the tables that this session staged below the shared folder.
    For use between jobs, when no frame that reads them is needed any more."""
    remove(spark, "/".join([ensure_checkpoint_dir(spark).rstrip("/"), "sevscope", _SESSION]))
