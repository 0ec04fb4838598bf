"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _flat(df: DataFrame) -> DataFrame:
    """CSV holds no nested values: arrays, structs and maps are written as JSON text."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")}
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> str:
    _flat(df).write.option("header", True).csv(path)
    return path


def write_parquet_plain(df: DataFrame, path: str) -> str:
    """Uncompressed parquet."""
    df.write.option("compression", "none").parquet(path)
    return path


def write_by_extension(df: DataFrame, path: str) -> str:
    """Parquet or CSV by the file extension; anything else is an error."""
    if path.endswith(".parquet"):
        df.write.parquet(path)
    elif path.endswith(".csv"):
        write_csv(df, path)
    else:
        raise ValueError(f"unsupported file format for {path}")
    return path


def convert_csv_to_parquet(spark: SparkSession, source: str, target: str, schema) -> str:
    spark.read.schema(schema).option("header", True).csv(source).write.parquet(target)
    return target


def dataset_layout(root: str, dataset: str, min_events: int, ext: str = "parquet") -> dict[str, str]:
    """Output paths of the two tables of a prepared data set."""
    if ext not in ("parquet", "csv"):
        raise ValueError(f"unsupported output type {ext!r}")
    name = f"{dataset}_{min_events}.{ext}"
    return {"interaction": f"{root}/interaction/{name}", "information": f"{root}/information/{name}"}


def write_dataset(interactions: DataFrame, items: DataFrame, layout: dict[str, str]) -> dict[str, str]:
    write_by_extension(interactions, layout["interaction"])
    write_by_extension(items, layout["information"])
    return layout


def write_splits(df: DataFrame, path: str) -> str:
    """Rows with a ``split`` column -> one folder per split, in a single pass."""
    df.write.partitionBy("split").parquet(path)
    return path


def write_shards(df: DataFrame, path: str) -> str:
    """Rows with a ``shard`` column -> one folder per shard."""
    df.write.partitionBy("shard").parquet(path)
    return path
