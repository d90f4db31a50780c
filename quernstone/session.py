"""Session helpers: table loading and the shared folder that cuts lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_LEFT: set[str] = set()


def build_session(app: str = "quernstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; every other knob stays with the cluster's own settings."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a dataset folder; columns are pruned by whoever selects from it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan over at least as many tasks as there are cores: where small files make fewer, rows are dealt anew, so that work
    that takes long for each row does not wait for one task. Larger tables stay as they lie. Only for plans without a
    shuffle, as the number of their tasks is known before they run."""
    n = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(n) if scan.rdd.getNumPartitions() < n else scan


def tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the Parquet tables in a folder."""
    fs, p = hadoop_fs(spark, folder)
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    return sorted(x.removesuffix(".parquet") for x in names if x.endswith(".parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local folder only on a local master."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there:
        return there.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quernstone-")
    return _OWN[app]


def hadoop_fs(spark: SparkSession, path: str):
    """The file system of a path, and the path as that system's own."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is left there is deleted when Python exits."""
    path = f"{shared_dir(spark)}/quernstone/{name}-{uuid.uuid4().hex}"
    if not _LEFT:
        atexit.register(_sweep)
    _LEFT.add(path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later plan reads."""
    for path in paths:
        fs, p = hadoop_fs(spark, path)
        fs.delete(p, True)
        _LEFT.discard(path)


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_LEFT):
        try:
            if spark is not None:
                discard(spark, path)
        except Exception:  # the session or the folder is gone already
            pass
        _LEFT.discard(path)


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
