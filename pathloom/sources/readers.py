"""Readers.  All are plain DataFrame scans, so column pruning and filters reach the files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.sources import schemas


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_event_table(spark: SparkSession, path: str) -> DataFrame:
    """A public event data set saved as parquet."""
    return spark.read.parquet(path)


def read_histories(spark: SparkSession, path: str) -> DataFrame:
    """Nested histories: ``user_id, item_id[], timestamp[]`` and ``segment``, if the file has one."""
    df = spark.read.parquet(path)
    segment = [c for c in df.columns if c == "segment"]
    return df.select(
        "user_id", *segment, F.col("object_id").alias("item_id"), F.col("event_time").alias("timestamp")
    )


def read_interactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose header line is replaced by ``item_id, user_id, timestamp``."""
    return spark.read.schema(schemas.INTERACTIONS).option("header", True).option("enforceSchema", True).csv(path)


def read_ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV without a header line: ``user_id, item_id, rating, timestamp``."""
    return spark.read.schema(schemas.RATINGS).option("header", False).csv(path)


def read_sessions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Session CSV; ``prev_items`` is a list written as text."""
    return spark.read.schema(schemas.SESSIONS).option("header", True).option("escape", '"').csv(path)


def session_items(prev_items: Column) -> Column:
    """Items of a session list written as text, e.g. ``['a' 'b']`` or ``[1, 2]``."""
    return F.regexp_extract_all(prev_items, F.lit(r"([^\s,'\"\[\]]+)"), F.lit(1))


def _bare_word(line: Column, word: str, replacement: str) -> Column:
    """Replace ``word`` outside quoted strings."""
    single = r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"
    double = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    first = word[0]
    outside = rf"\G((?:[^'\"{first}]++|{single}|{double}|{first}(?!{word[1:]}\b))*+){word}\b"
    return F.regexp_replace(line, outside, "$1" + replacement)


def _parse_records(spark: SparkSession, path: str) -> DataFrame:
    line = F.col("value")
    for word, json_word in (("None", "null"), ("True", "true"), ("False", "false")):
        line = _bare_word(line, word, json_word)
    options = {"columnNameOfCorruptRecord": "_broken", "allowBackslashEscapingAnyCharacter": "true"}
    parsed = F.from_json(line, f"{schemas.ITEM_RECORD}, _broken STRING", options)
    return spark.read.text(path).select("value", parsed.alias("r"))


def read_item_records(spark: SparkSession, path: str) -> DataFrame:
    """One dict literal per line -> ``item_id, description, title``; absent values become ''."""
    good = _parse_records(spark, path).filter(F.col("r._broken").isNull())
    return good.select(
        F.coalesce("r.asin", F.lit("")).alias("item_id"),
        F.coalesce("r.description", F.lit("")).alias("description"),
        F.coalesce("r.title", F.lit("")).alias("title"),
    )


def read_item_record_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The lines ``read_item_records`` could not parse."""
    return _parse_records(spark, path).filter(F.col("r._broken").isNotNull()).select("value")


def read_item_info(spark: SparkSession, path: str, text_keys: Sequence[str]) -> DataFrame:
    """Item text by id; only parquet is accepted."""
    if not path.endswith(".parquet"):
        raise ValueError(f"unsupported file format: {path}")
    return spark.read.parquet(path).select(F.col("object_id").alias("item_id"), *text_keys)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("split") == split).drop("split")


def resolve_format(spark: SparkSession, base: str) -> tuple[str, str]:
    """(format, path) of ``base.csv`` if it exists, else of ``base.parquet``, else an error."""
    for ext in ("csv", "parquet"):
        try:
            spark.read.format("binaryFile").load(f"{base}.{ext}")  # checks the path, reads nothing
        except AnalysisException:
            continue
        return ext, f"{base}.{ext}"
    raise ValueError(f"neither {base}.csv nor {base}.parquet exists")
