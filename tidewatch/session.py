"""Session helpers shared by tests, the benchmark and the registered queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tidewatch", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One parquet table of a dataset directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session without the setting falls back to a fresh temporary
    folder, which stays that application's folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(_FALLBACK[app])
    return _FALLBACK[app]


SCRATCH_PREFIX = "tidewatch-scratch-"
_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = f"{shared_dir(spark)}/{SCRATCH_PREFIX}{uuid.uuid4().hex}"
    return _SCRATCH[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For small tables several later steps read (per-key summaries, folded
    matches): the big input is scanned once, a lost executor costs only its own
    tasks, and the written size is what join planning sees.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


#: Shuffle files go once the query that made them is done.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def step(df: DataFrame, name: str) -> DataFrame:
    """``materialise`` for one of many steps: the shuffle files behind it go at once.

    Otherwise they stay until the driver happens to collect its garbage. For a plan
    of its own only: what is cached or read by another query keeps its files.
    """
    conf = df.sparkSession.conf
    before = conf.get(DROP_SHUFFLES)
    conf.set(DROP_SHUFFLES, "true")
    try:
        return materialise(df, name)
    finally:
        conf.set(DROP_SHUFFLES, before)


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialise`` or ``step`` that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove this application's intermediate tables once nothing reads them."""
    path = _SCRATCH.pop(spark.sparkContext.applicationId, None)
    if path:
        _delete(spark, path)
