"""Tables written on the way: in the folder that a cluster names in spark.checkpoint.dir.

They are removed as soon as nothing can read them any more: by operators that know it, by a caller's ``scratch`` block, else when the
driver's Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_scopes: list[list[str]] = []  # open scopes of scratch()
_left: dict[str, tuple] = {}  # what is still to be removed, with what it takes to do so


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where that is unset and all tasks run in the driver's process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        path = tempfile.mkdtemp(prefix="parqsieve-")
        _own_dirs[app] = f"file://{path}"
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return _own_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    if not _left:
        atexit.register(_remove_left)
    _left[path] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    return path


def _remove(path: str, jvm: Any, conf: Any) -> None:
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def _remove_left() -> None:
    while _left:
        path, how = _left.popitem()
        with contextlib.suppress(Exception):  # the JVM may be gone by now
            _remove(path, *how)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes what is written to the shared folder within the block, at its end; for callers that have written their result elsewhere by then.

    Results of the operators read such tables, so one that is handed out lazily keeps them until the caller's scope ends."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            delete_path(spark, path)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    _left.pop(path, None)
    _remove(path, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
