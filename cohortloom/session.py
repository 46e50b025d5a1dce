"""Session helpers: table access, lineage cuts in the cluster's shared folder, scan-side cleaning."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STAGED: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, lazily; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset (tests)."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="cohortloom-")
        sc.setCheckpointDir(known)
    return known


def staged_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; removed by ``release`` or when Python ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def stage(df: DataFrame, label: str = "stage", partition_by: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    Survives the loss of executors, is columnar and compressed, and lets later scans prune columns."""
    spark = df.sparkSession
    path = staged_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a staged path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def release() -> None:
    """Remove every staged table. For long sessions, once the results built on them are written; runs when Python ends too."""
    while _STAGED:
        spark, path = _STAGED.pop()
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            pass


def denan(c: str | Column) -> Column:
    """NaN to NULL, so that aggregates skip it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def try_number(c: str | Column) -> Column:
    """Text to DOUBLE; anything else, and a typed NaN, to NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return denan(F.trim(c).try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def pearson(x: str | Column, y: str | Column) -> Column:
    """Pearson's r over the rows with both values; NULL (rather than an error under ANSI rules) where one of them is constant."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = (F.when(x.isNotNull() & y.isNotNull(), c.cast("double")) for c in (x, y))
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
