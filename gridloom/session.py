"""Session helpers shared by every part of the package."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
#: Rows and bytes that go to Python workers at once, where the session sets neither: texts can be long.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}
_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}
_stored: dict[tuple[str, str], list[str]] = {}
_scope: ContextVar[str] = ContextVar("scope", default="")


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "gridloom", **conf) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, and bound what workers get at once."""
    app = spark.sparkContext.applicationId
    for key, value in ARROW.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="gridloom-ship-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, f"gridloom_{app.replace('-', '_')}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(_PACKAGE.rglob("*.py")):
            archive.write(file, f"{_PACKAGE.name}/{file.relative_to(_PACKAGE)}")
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where that setting is absent, a local session gets a folder of this process; on a
    cluster other machines would not see such a folder, so RuntimeError.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="gridloom-shared-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return "file://" + _own_dirs[app]


@contextlib.contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables stored here belong to ``name``; ``release`` of that name deletes them and no others."""
    before = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(before)


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{shared_dir(spark)}/gridloom/{label}-{uuid.uuid4().hex}"
    _stored.setdefault((spark.sparkContext.applicationId, _scope.get()), []).append(path)
    return path


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage: a lost executor costs only what it was running, as
    the table does not live on executors.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def place(path: str):
    """A pyarrow file system and a path in it, wherever Python can open files: local, shared or an object store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession, name: str) -> None:
    """Delete the tables stored in a scope so far; nothing may read them any more."""
    for path in _stored.pop((spark.sparkContext.applicationId, name), []):
        delete_path(spark, path)
