"""Tables to read: files, JDBC and catalogs, with paging and statistics."""

from __future__ import annotations

import math

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv", "jdbc", "table")


def read(spark: SparkSession, kind: str, path: str | None = None, **options) -> DataFrame:
    """A source by kind; unknown kinds raise."""
    if kind == "table":
        return spark.table(path)
    if kind not in FORMATS:
        raise ValueError(f"no source named {kind}")
    reader = spark.read.format(kind).options(**{k: str(v) for k, v in options.items()})
    return reader.load(path) if path else reader.load()


def read_all(spark: SparkSession, sources: dict[str, dict]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Named sources (the arguments of ``read``): those that can be read, and
    the reasons of those that can't, so that one missing source stops no other."""
    found, failed = {}, {}
    for name, source in sources.items():
        try:
            found[name] = read(spark, **source)
        except (ValueError, PySparkException, Py4JError) as error:
            failed[name] = str(error)
    return found, failed


def jdbc_options(env: dict[str, str]) -> dict[str, str]:
    """JDBC options from the environment: one URL, or its parts."""
    url = env.get("SOURCE_URL") or f"jdbc:{env.get('SOURCE_TYPE', 'postgresql')}://{env.get('DB_HOST', 'localhost')}:{env.get('DB_PORT', '5432')}/{env.get('DB_NAME', 'postgres')}"
    return {"url": url, "dbtable": env.get("DB_TABLE", "users"), "user": env.get("DB_USER", ""), "password": env.get("DB_PASSWORD", "")}


def read_jdbc(spark: SparkSession, options: dict[str, str], key: str = "id", partitions: int = 16, bounds: tuple[int, int] | None = None) -> DataFrame:
    """A JDBC table read in ranges of a numeric key, when its bounds are given."""
    more = {} if bounds is None else {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**options, **more).load()


def stats(df: DataFrame) -> dict:
    return {"total_rows": df.count(), "columns": df.columns}


def paged(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows with the number of the page (from 0) that an ordered reader with
    ``size`` rows a page would meet them on. Ranges of the key are sorted side
    by side and their counts added up, so no task sees all rows."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, F.col(key)).withColumn("_p", F.spark_partition_id())
    counts = ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(F.col(key).asc_nulls_first()))
    numbered = ordered.withColumn("_i", local).join(F.broadcast(offsets), "_p")  # one row for each shuffle partition
    return numbered.withColumn("chunk_id", F.floor((F.col("_before") + F.col("_i") - 1) / size).cast("long")).drop("_p", "_i", "_before")


def pages(total: int, size: int) -> int:
    return math.ceil(total / size) if total else 0


def column_constraints(columns: DataFrame, constraints: DataFrame, usage: DataFrame, table: str) -> DataFrame:
    """column_name, data_type, is_nullable, column_default, is_unique of a table
    from an information schema; each column of a composite key counts as unique."""
    kinds = constraints.filter((F.col("table_name") == table) & F.col("constraint_type").isin("UNIQUE", "PRIMARY KEY")).select("constraint_name", "table_name")
    unique = usage.join(kinds, ["constraint_name", "table_name"]).select("column_name").distinct().withColumn("is_unique", F.lit(True))
    own = columns.filter(F.col("table_name") == table).join(unique, "column_name", "left")
    return own.select("column_name", "data_type", (F.col("is_nullable") == "YES").alias("is_nullable"), "column_default", F.coalesce("is_unique", F.lit(False)).alias("is_unique")).orderBy("ordinal_position")


def files_state(spark: SparkSession, path: str) -> list[str]:
    """Name, size and time of change of every file under a path: equal as long as nothing there changed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    out = []
    while found.hasNext():
        f = found.next()
        out.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return sorted(out)
