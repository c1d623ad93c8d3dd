"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.unionOutputPartitioning": "false",
}


def build(master: str = "local[*]", app: str = "wardloom", **conf: str) -> SparkSession:
    """A session with the library's defaults; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def guard(spark: SparkSession) -> SparkSession:
    """Switch off a planner feature that gives wrong results.

    Spark 4.1.2 lets a union claim the partitioning of its children; where a
    child is a projection with a literal column, a grouping above it is then
    not shuffled although equal keys lie in different partitions, and groups
    come out twice. Runtime setting, no effect on versions without it.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


@contextmanager
def interpreted(spark: SparkSession) -> Iterator[None]:
    """Plans run inside are interpreted, not compiled: for many steps on small tables, where compiling costs more than running."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode")}
    try:
        spark.conf.set("spark.sql.codegen.wholeStage", "false")
        spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def scratch_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; every executor must see it.

    Where the setting is absent (tests, a laptop) a local folder is used, but
    only in local mode: on a cluster a machine-local folder would lose data.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='wardloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage like ``checkpoint()`` but computes the plan once and stays
    columnar. The files outlive any executor.
    """
    spark = guard(df.sparkSession)
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files behind frames made by :func:`materialize` that no later plan reads."""
    for df in frames:
        path = getattr(df, "scratch", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
