"""Session defaults, shared-folder materialisation and partition sizing."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_CHECKPOINTS: list[str] = []
_PATHS: dict[int, tuple[DataFrame, str]] = {}


def build_session(app: str = "molquarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE with skew joins, Arrow transfer."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local a temporary folder is made and set instead; a
    cluster without the setting is refused, as no folder of one machine would do.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="molquarry-ckpt-")
    _LOCAL_CHECKPOINTS.append(made)
    spark.conf.set("spark.checkpoint.dir", "file://" + made)
    return "file://" + made


@atexit.register
def _drop_local() -> None:
    for p in _LOCAL_CHECKPOINTS:
        shutil.rmtree(p, ignore_errors=True)


def opened(path: str) -> str:
    """``path`` as Python workers can open it: with the scheme of the session's default file system."""
    if "://" in path or path.startswith("file:"):
        return path
    spark = SparkSession.active()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def write_shared(df: DataFrame, name: str) -> str:
    """Write ``df`` into the shared folder; its path, which every executor can open."""
    path = f"{shared_dir(df.sparkSession)}/molquarry/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return path


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and keeps later scans columnar. The table
    stays until the application's folder is cleared, since lazy results may still read it.
    """
    path = write_shared(df, name)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (out, path)
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that no later stage reads."""
    for df in tables:
        out, path = _PATHS.pop(id(df), (None, None))
        if out is df:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Give a CPU-heavy Python stage enough tasks when its input has too few partitions.

    Judged by the size of what the plan reads, so nothing runs; an input of enough splits (any large one)
    is left alone, so nothing is shuffled.
    """
    spark = df.sparkSession
    want = parallelism(spark) * per_core
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    conf = spark._jsparkSession.sessionState().conf()
    # the size at which scans cut files
    cut = min(int(conf.filesMaxPartitionBytes()), max(int(conf.filesOpenCostInBytes()), (size + int(conf.filesOpenCostInBytes())) // parallelism(spark)))
    splits = -(-size // max(cut, 1))
    return df if splits >= want else df.repartition(want)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
