"""Sessions, tables, and tables written on the way in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks: UTC, adaptive execution, few shuffle partitions."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("leafwork")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the application's Python workers, once, so that they
    need neither an installation nor the driver's working folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.realpath(__file__))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="leafwork-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = os.path.join(folder, "leafwork.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for inner, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(inner, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, which the
    driver and all executors share.  Only a local master may go without that
    setting; it then gets a temporary folder of its own."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="leafwork-")
            spark.conf.set("spark.checkpoint.dir", base)
        _scratch[app] = f"{base.rstrip('/')}/leafwork-{uuid.uuid4().hex}"
        atexit.register(clean, spark)
    return _scratch[app]


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a table that cut() wrote, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Deletes all tables that cut() wrote in this application."""
    path = _scratch.pop(spark.sparkContext.applicationId, None) if spark.sparkContext._jsc else None
    if path:
        try:
            drop_table(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            pass


class Scope:
    """Tables that cut() writes inside ``with Scope(spark) as scope`` are deleted at its
    end, but for those that ``scope.keep`` names: what is read after it."""

    _open: list[Scope] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], []

    def __enter__(self) -> Scope:
        Scope._open.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """A table that cut() returned stays, in the scope around this one if there is one."""
        self.kept.append(df._cut_path)
        return df

    def __exit__(self, *_) -> None:
        Scope._open.remove(self)
        for path in self.paths:
            if path not in self.kept:
                drop_table(self.spark, path)
            elif Scope._open:
                Scope._open[-1].paths.append(path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared scratch folder and reads it back.

    This cuts the lineage, so that a lost executor costs the recomputation of
    the tasks since then only, and an expensive step runs once."""
    path = write_cut(df, name)
    out = read_cut(df.sparkSession, path, df)
    out._cut_path = path
    return out


def write_cut(df: DataFrame, name: str) -> str:
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    if Scope._open:
        Scope._open[-1].paths.append(path)
    return path


def read_cut(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)
