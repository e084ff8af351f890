"""Session settings and the shared folder used for checkpoints and stage tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution splits skewed join partitions and picks broadcast sides from
# measured sizes; the one broadcast hint in this package follows a count of its rows.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_FRESH: dict[str, str] = {}


def local_session(cores: int | str = "*", app: str = "cotflow", **extra: str) -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **SETTINGS,
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session of one JVM (``local`` or ``local[n]``) may go without the setting; it then
    gets a folder that is removed when Python ends. On a cluster a machine-local folder would be
    lost with its executor, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _FRESH:
        _FRESH[app] = tempfile.mkdtemp(prefix="cotflow-")
        atexit.register(shutil.rmtree, _FRESH[app], ignore_errors=True)
    return _FRESH[app]


_STAGES: dict[str, list[str]] = {}


def stage_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder, for what reads it several times."""
    path = stage_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_TABLES: dict[str, list[str]] = {}


def stage_table(spark: SparkSession, name: str) -> str:
    """A catalog name that no other run uses, for a staged table that needs one."""
    unique = f"{name}_{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(unique)
    return unique


def write_file(spark: SparkSession, path: str, data: bytes, overwrite: bool = False) -> None:
    """A small file of a given name, in whatever store the path names; whole or not at all."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place, draft = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = store.create(draft)
    out.write(bytearray(data))
    out.close()
    if overwrite:
        store.delete(place, False)
    if (not overwrite and store.exists(place)) or not store.rename(draft, place):
        store.delete(draft, False)
        raise FileExistsError(path)


def drop_stage(spark: SparkSession, path: str) -> None:
    """Delete one staged table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop_stages(spark: SparkSession) -> None:
    """Delete what this session staged; call it when no result that reads a stage is needed."""
    for name in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in _STAGES.pop(spark.sparkContext.applicationId, []):
        drop_stage(spark, path)
