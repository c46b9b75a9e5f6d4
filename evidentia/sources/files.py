"""Table sources and sinks: CSV, JSON, JSON lines, shards, manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from evidentia.common import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/evidentia-{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed CSV scan; quotes doubled, line breaks in cells allowed."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def read_text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV scan with every cell as text; empty cells are empty text, never null."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', nullValue="\x00", emptyValue="")
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def read_optional(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV scan, or an empty frame with the schema if there is nothing at the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return read_csv(spark, path, schema)


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the columns it lacks added as nulls of the given type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """Tolerant JSON lines: bad lines are skipped, the last record of a key wins."""
    rows = spark.read.schema(schema).json(path, mode="DROPMALFORMED").where(F.col(key).isNotNull())
    return last_wins(rows, key, order)


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_x")).select(key, *[F.col(f"_x.{c}").alias(c) for c in rest])


def union_shards(shards: list[DataFrame], key: str, order: str) -> DataFrame:
    """Rows of all shards; a key in a later shard overrides earlier ones."""
    parts = [x.withColumn("_shard", F.lit(i)) for i, x in enumerate(shards)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    rest = [c for c in u.columns if c not in (key, "_shard")]
    best = u.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_shard", order)).alias("_x"))
    return best.select(key, *[F.col(f"_x.{c}").alias(c) for c in rest])


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as text for CSV: arrays of text joined by ';' in order, other nested values as JSON."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StringType):
            c = F.array_join(F.array_sort(c), ";")
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> str:
    flat(df).write.csv(path, header=True, escape='"', emptyValue="")
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.json(path)
    return path


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files under a path, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def shards_of(df: DataFrame, order: str, size: int) -> DataFrame:
    """df with `shard`: consecutive runs of `size` rows in the given order."""
    from evidentia.operators.relational import global_rank

    return global_rank(df, [F.asc(order)]).withColumn("shard", F.floor((F.col("rank") - 1) / size).cast("int")).drop("rank")


def single_window(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """df with `at`, the place of a row among those with its keys."""
    return df.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
