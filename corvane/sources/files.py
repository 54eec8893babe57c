"""Scans that know their files: record numbers, sidecars, changed sources, older schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.joins import checked_join


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, line): the lines of text files, each with its number in its file from 0, however the files are split.

    A task reads blocks of files from front to back, so that a line's number is its place in its block and the lines of
    the file's blocks before.  Blocks are counted in a first scan, which reads no more than line ends.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    blocks = raw.groupBy("file", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    return raw.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("place") - F.col("first")).alias("seq"), "line")


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, seq, the schema's columns, error) of JSON lines: a line that is no record has nulls and the error 'bad json'; blank lines count in seq and are left out."""
    fields = [f.name for f in T._parse_datatype_string(schema)]
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    kept = F.from_json("line", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    lines = lines.withColumn("r", kept)
    bad = F.col("r._corrupt").isNotNull() | F.col("r").isNull()
    return lines.select("file", "seq", *[F.when(~bad, F.col(f"r.{f}")).alias(f) for f in fields], F.when(bad, F.lit("bad json")).alias("bad"))


def latest_record(records: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the record that was written last: by file name, then by number in the file."""
    return records.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in records.columns if c not in keys]), F.struct("file", "seq")).alias("r")).select(*keys, "r.*")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, modified) of the files under a pattern, without reading them."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def stale_sources(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(name, status) of the sources that are missing or changed since they were recorded with size and modified, or are new."""
    a = recorded.select("name", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"), F.lit(True).alias("was"))
    b = current.select("name", "size", "modified", F.lit(True).alias("is"))
    same = F.col("size").eqNullSafe(F.col("old_size")) & F.col("modified").eqNullSafe(F.col("old_modified"))
    status = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "new").when(~same, "changed")
    return a.join(b, "name", "full").select("name", status.alias("status")).where("status is not null")


def run_name(name: Column, ending: str) -> Column:
    """A source's run: its file name without the ending."""
    return F.substring(name, F.lit(1), F.length(name) - len(ending))


def sidecars(spark: SparkSession, path: str, schema: str, ending: str = ".meta.json") -> DataFrame:
    """(run, the schema's columns) of JSON files, one object each; a broken one has nulls."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.from_json("value", schema).alias("m"))
    return raw.select(run_name(F.col("name"), ending).alias("run"), "m.*")


def sources(spark: SparkSession, folder: str, schema: str, *, ending: str = "_judged.csv", only: str | None = None, smoke: bool = False) -> DataFrame:
    """(run, name, size, modified, skipped, the sidecar's columns) of the runs in a folder, each with at most one sidecar.

    A run whose name marks it as a smoke test is skipped for that reason unless asked for; ``only`` keeps names that contain it.
    """
    from corvane.functions.text import is_smoke_run

    found = listing(spark, f"{folder}/*{ending}").withColumn("run", run_name(F.col("name"), ending))
    if only:
        found = found.where(F.contains("name", F.lit(only)))
    found = found.withColumn("skipped", F.when(is_smoke_run(F.col("run")) & ~F.lit(smoke), F.lit("smoke")))
    try:
        side = sidecars(spark, f"{folder}/*.meta.json", schema)
    except Exception as e:  # no sidecar at all
        if "PATH_NOT_FOUND" not in str(e):
            raise
        side = spark.createDataFrame([], f"run string, {schema}")
    return checked_join(found, side, ["run"], name="sidecars").select("run", "name", "size", "modified", "skipped", *[c for c in side.columns if c != "run"])


def read_upgraded(spark: SparkSession, path: str, schema: str, added: dict[str, Column]) -> DataFrame:
    """A Parquet table in ``schema``: columns that an older version lacks are made by ``added``, others that are missing are an error.

    Files of several versions may lie together: where a file lacks an added column, its rows get the default.
    """
    want = T._parse_datatype_string(schema)
    df = spark.read.option("mergeSchema", "true").parquet(path)
    if missing := [f.name for f in want if f.name not in df.columns and f.name not in added]:
        raise ValueError(f"{path} lacks {missing}")
    value = lambda n: F.coalesce(F.col(n), added[n]) if n in df.columns and n in added else added[n] if n in added else F.col(n)
    return df.select(*[value(f.name).cast(f.dataType).alias(f.name) for f in want])
