"""Session helpers shared by every operator: table access, cell hygiene, lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that stands for "nothing here", compared after trimming and lower-casing.
UNUSABLE = ("", "nan", "none", "null")
BLANKS = " \t\r\n "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bare(c: Column | str) -> Column:
    """Text without surrounding blanks."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def usable(c: Column | str) -> Column:
    """Trimmed text, or null where it is null, blank, nan, none or null in any case."""
    t = bare(c)
    return F.when(~F.lower(t).isin(*UNUSABLE), t)


def clean_id(c: Column | str) -> Column:
    """A usable id, trimmed and lower-cased; null otherwise."""
    return F.lower(usable(c))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only a local master may fall back to a temporary one."""
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    known = getattr(sc, "_evidentia_dir", None)
    if known is None:
        known = sc._evidentia_dir = "file://" + tempfile.mkdtemp(prefix="evidentia-")
        atexit.register(lambda: __import__("shutil").rmtree(known[7:], ignore_errors=True))
    return known


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, sizes become known, lost executors do not matter."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evidentia-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)  # with the driver; drop_cut is earlier
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame | None) -> None:
    """Remove the files of a cut that nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for work that costs far more than moving a row. A table of that many files or splits is
    left where it is, so on large tables this is no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
