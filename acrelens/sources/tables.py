"""Reading and writing tables, line lists and records."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from acrelens.config import BUSINESS, CONDITIONS


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the cluster's shared folder, spark.checkpoint.dir; only a local session may do without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='acrelens-')}"
    return f"{found}/files/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """`df` written below scratch() and read again, so that its plan runs once whatever uses it."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again.stored_at = path
    return again


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table, whatever the store is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A headed CSV's columns of the declared schema, found by the names in its header, in whatever order they stand.

    What can't be parsed is null, a declared column that the header lacks is an error, others are ignored. The files of a folder
    have one header.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])


def write_table(df: DataFrame, path: str, columns: list[str], kind: str = "parquet", partition_by: tuple = ()) -> None:
    """The named columns in their order, whatever else `df` has. A partitioned table replaces only the partitions that it brings."""
    out = df.select(*columns).write.mode("overwrite")
    if partition_by:
        out = out.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    (out.option("header", True).csv if kind == "csv" else out.parquet)(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value != ''")


def write_lines(df: DataFrame, path: str) -> None:
    df.select(F.col(df.columns[0]).cast("string").alias("value")).write.mode("overwrite").text(path)


def as_record(df: DataFrame) -> DataFrame:
    """Each row as a JSON text with its keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_record(df: DataFrame, path: str) -> None:
    as_record(df).write.mode("overwrite").text(path)


def read_record(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A record's declared fields; a text that isn't JSON of that schema is an error, fields that it lacks are null, others are ignored."""
    rows = spark.read.text(path, wholetext=False).where("trim(value) <> ''")
    return rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_by_region(df: DataFrame, path: str, cell: str = "geohash", length: int = 3, region: str = "region") -> None:
    """A table in parts by the cells' prefix, one exchange by prefix first, so that a part has few files."""
    rows = df.withColumn(region, F.substring(cell, 1, length))
    rows.repartition(region, F.pmod(F.xxhash64(cell), F.lit(8))).write.mode("overwrite").partitionBy(region).parquet(path)


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, length and modificationTime of all files below a folder, at any depth, whose names match; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", "length", "modificationTime")


def read_found(spark: SparkSession, root: str, schema: StructType | str, pattern: str, level: int = -1, glob: str = "*.csv") -> DataFrame:
    """Rows of all found files below `root`, with the path of their file and the year in it: find_inputs() on the rows' own files.

    Files are headed CSV of the declared schema. Those that the rule leaves out aren't opened, as Spark prunes files by the filter on their path.
    """
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).csv(root)
    return find_inputs(rows.select("*", F.col("_metadata.file_path").alias("path")), pattern, level)


def read_business(spark: SparkSession, path: str) -> DataFrame:
    """Headerless files with | between 28 padded fields."""
    rows = spark.read.schema(BUSINESS).option("sep", "|").csv(path)
    return rows.select(*[F.trim(F.col(f.name)).alias(f.name) if f.dataType == StringType() else f.name for f in BUSINESS])


def find_inputs(paths: DataFrame, pattern: str = r"(\d{4})", level: int = -1) -> DataFrame:
    """Of a table with a path those of files that hold a year, without side files, and that year.

    The name is the path's last part, or that of a folder: the part at `level`. Where a file is a folder, of Spark's part files, it is the one before.
    """
    name = F.element_at(F.split("path", "/"), level)
    return paths.where(name.rlike(pattern) & ~name.endswith(".aux.xml")).withColumn("year", F.regexp_extract(name, pattern, 1).cast("int"))


def read_years(spark: SparkSession, path: str) -> DataFrame:
    """A table whose years have been written at different times: columns that only some of them have are null in the others."""
    return spark.read.option("mergeSchema", True).parquet(path)


def union_years(parts: list[DataFrame]) -> DataFrame:
    """Yearly tables one below the other, by the names of their columns; what a year lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def manifest(years: DataFrame, variables: list[str], conditions: tuple = CONDITIONS, day_gap: int = 1) -> DataFrame:
    """variable, condition, date of every raster of the years, every `day_gap` days from each January 1."""
    days = years.select(F.explode(F.sequence(F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31)), F.make_interval(days=F.lit(day_gap)))).alias("date"))
    each = F.array(*[F.struct(F.lit(v).alias("variable"), F.lit(c).alias("condition")) for v in variables for c in conditions])
    return days.select("date", F.explode(each).alias("x")).select("x.variable", "x.condition", "date")


def raster_name(variable, condition, date) -> F.Column:
    """File name of a manifest row: variable.yyyy.MM.dd.tif, with the condition before it unless observed; rainfall has names of its own."""
    observed, rain = condition == "observations", variable == "chirps-v2"
    name = F.when(observed & rain, "chirps-v2.0").when(rain, "CHIRPS").otherwise(variable)
    return F.concat_ws(".", F.when(~observed, condition), name, F.date_format(date, "yyyy.MM.dd"), F.lit("tif"))


def pixels(spark: SparkSession, path: str, lowest: float = 0.0, strictly: bool = False) -> DataFrame:
    """A pixel table without what holds no data (below `lowest`, or at it with `strictly`)."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("value") > lowest if strictly else F.col("value") >= lowest)
