"""Reading events: CSV parts, Parquet, registered frames, samples."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismcube.errors import WarehouseError
from prismcube.model import CubeModel


def files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Files of a folder in any storage that Spark reads, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise WarehouseError(f"{folder} does not exist")
    found = [s.getPath() for s in fs.listStatus(path) if s.isFile()]
    return sorted(p.toString() for p in found if fnmatch(p.getName(), pattern))


def head(spark: SparkSession, path: str) -> str:
    """A file's first line, without a job."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    io = spark._jvm.java.io
    reader = io.BufferedReader(io.InputStreamReader(p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p), "UTF-8"))
    try:
        return (reader.readLine() or "").lstrip("\ufeff")
    finally:
        reader.close()


def read_csv(spark: SparkSession, folder: str, model: CubeModel, pattern: str = "*.csv", strict: bool = False, infer: bool = False) -> DataFrame:
    """All CSV parts of a folder, columns matched by their headers.

    Empty fields are null, nothing else is ('NA' is text). A malformed field is null and the row's others are kept;
    with strict the read fails on it. Columns that a part lacks are null. infer takes types from the data instead.
    Parts of any size are split by spark.sql.files.maxPartitionBytes.
    """
    paths = files(spark, folder, pattern)
    if not paths:
        raise WarehouseError(f"{folder} has no {pattern}")
    if infer:
        return spark.read.option("header", True).option("inferSchema", True).csv(paths)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for p in paths:
        names = tuple(c.strip().strip('"') for c in head(spark, p).split(",") if c.strip())
        by_header.setdefault(names, []).append(p)
    parts = [_typed(spark.read.option("header", True).schema(_text(names)).csv(some), model, strict) for names, some in by_header.items() if names]
    if not parts:
        return spark.createDataFrame([], model.schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _text(names: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _typed(rows: DataFrame, model: CubeModel, strict: bool) -> DataFrame:
    columns = []
    for f in model.schema.fields:
        if f.name not in rows.columns:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            columns.append(F.col(f.name))
        else:
            text = F.nullif(F.trim(F.col(f.name)), F.lit(""))
            columns.append((text.cast(f.dataType) if strict else text.try_cast(f.dataType)).alias(f.name))
    return rows.select(*columns)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def convert(events: DataFrame, path: str, compression: str = "snappy") -> None:
    """Events as Parquet."""
    events.write.mode("overwrite").option("compression", compression).parquet(path)


def registered(events: DataFrame, name: str) -> DataFrame:
    """Events as a temporary view of that name."""
    events.createOrReplaceTempView(name)
    return events


def column_sample(events: DataFrame, column: str, n: int) -> DataFrame:
    """The first n values of a column."""
    return events.select(F.col(f"`{column}`")).limit(n)


def row_sample(events: DataFrame, ratio: float, seed: int = 0) -> tuple[DataFrame, float]:
    """A random share of the rows, and the factor that scales its counts to all."""
    return events.sample(ratio, seed), 1 / ratio
