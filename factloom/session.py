"""Session settings and the shared staging folder.

Settings only name what the engine relies on; a cluster's own configuration wins
wherever it is already set.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a local session starts with; a cluster passes its own.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("factloom")
    settings = LOCAL_CONF | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | conf
    return builder.config(map=settings).getOrCreate()


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows over all of the session's shuffle partitions, by keys or in turn.

    For steps whose cost is in their expressions: adaptive execution merges partitions by
    their bytes, and would leave few short but costly rows to one or two tasks. A number
    that is asked for by name stays.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def unnested(rows: DataFrame, array: str, name: str, *kept: str) -> DataFrame:
    """One row per element that isn't null, with the kept columns.

    An outer explode, filtered afterwards: a plain one adds a filter on its input, which
    Catalyst pushes through the steps that made the array and so evaluates them repeatedly.
    """
    return rows.select(*kept, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application.

    Functions that run in Python workers are pickled by reference, so the workers must be
    able to import them wherever they run.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="factloom-code-")) / "factloom.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


#: Staged tables that are still in use, by the identity of their DataFrame.
_staged: dict[int, tuple] = {}


def staging_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Only where it is unset (tests, a single machine) a folder under the system's
    temporary folder is made and set as the context's checkpoint folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            found = current.get()
        else:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            found = tempfile.mkdtemp(prefix="factloom-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def moved(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder of any of Hadoop's file systems; False where there is none."""
    a, b = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    system = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(system.exists(a) and system.rename(a, b))


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder with all that is in it, if it is there."""
    _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, name: str, *, options: dict[str, str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table into the shared folder and read it back, cutting the lineage.

    by: columns that become folders, so that a filter on them reads only its own.

    Row order inside a file is kept, so a row id that was drawn before staging stays
    with its row whatever is recomputed later. The folder goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).partitionBy(*by).parquet(path)
    remove_at_exit(spark, path)
    staged = spark.read.schema(df.schema).parquet(path)
    _staged[id(staged)] = (weakref.ref(staged), path)
    return staged


def release(*tables: DataFrame) -> None:
    """Removes staged tables that nothing will read again, so that they take no room."""
    for df in tables:
        ref, path = _staged.pop(id(df), (lambda: None, ""))
        if ref() is df:
            _remove(df.sparkSession, path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver ends, if it is still there."""
    pid = os.getpid()

    def clean() -> None:
        if os.getpid() == pid:
            try:
                _remove(spark, path)
            except Exception:  # noqa: BLE001  the session may have ended first
                pass

    atexit.register(clean)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by a path that any of Spark's file systems may serve."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
