"""Readers and writers with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASELINE = "original_index long, prompt string, groundtruth string, additional_fields string, baseline_answer string, choices string, sample_answers string, n_top_votes int"
JUDGE_CACHE = "original_index long, hint_name string, judge_model string, prompt_hash string, input_sha string, label int, confidence double, hint_role string, hint_quote string, error string, _corrupt string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV of generated text: quoted line feeds and doubled quotes, typed by ``schema``."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def read_baseline(spark: SparkSession, path: str, schema: str = BASELINE) -> DataFrame:
    """Baseline rows with their JSON columns decoded; bad JSON is null."""
    df = read_csv(spark, path, schema)
    return df.withColumns({"choices": F.from_json("choices", "array<string>"), "sample_answers": F.from_json("sample_answers", "array<string>"), "additional_fields": F.from_json("additional_fields", "map<string,string>")})


def read_judge_cache(spark: SparkSession, path: str, schema: str = JUDGE_CACHE) -> DataFrame:
    """JSON lines of judge calls with their file and place; truncated lines are left out."""
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    placed = raw.select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("seq"))
    return placed.where("original_index is not null and hint_name is not null").drop("_corrupt")


def read_checked(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, its columns in the schema's order and types; a missing column is an error."""
    df = spark.read.parquet(path)
    if missing := [f.name for f in schema if f.name not in df.columns]:
        raise ValueError(f"{path} lacks {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def write_table(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = (), force: bool = False) -> None:
    """Parquet; an existing table is only replaced if ``force`` is set."""
    df.write.mode("overwrite" if force else "errorifexists").partitionBy(*partition_by).parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
