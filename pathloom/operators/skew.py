"""Building blocks that stay balanced when one key holds a large share of all rows.

* ``frequent_keys`` the few keys worth special treatment, as short driver-side values
* ``lookup``        equi-join with a table that is unique by key; frequent keys are salted
* ``positions``     row number inside a group; frequent groups are numbered from a
                    range-sorted table instead of in one window task
* ``global_index``  row number over the whole table without a one-partition window
* ``row_index``     the same in any order, without an exchange
* ``running_sums``  running totals over the whole table, same technique

``frequent`` may be passed to every function that takes it, so a pipeline finds its hot
users and items once; left out, it is found with one scan of the key column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.session import save_shared, slots

# A key is worth special treatment only above this many rows: below it one task sorts or
# joins the key without trouble whatever its share of the table is.  The session setting
# ``spark.pathloom.frequentRows`` overrides it.
FREQUENT_ROWS = 1_000_000
# Sampled rows a key of that size is expected to show when looking for frequent keys.
_SAMPLE_ROWS = 10_000


def frequent_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.pathloom.frequentRows", str(FREQUENT_ROWS)))


def frequent_keys(df: DataFrame, keys: str | Sequence[str], min_rows: int | None = None) -> list:
    """Keys with more than about ``min_rows`` rows: values of one column (None for null),
    or hashes of several columns.  At most four per task slot, the most frequent first, so a
    key left out holds under ``1 / (4 * slots)`` of the rows.

    Key counts come from a sample.  They only decide how rows are spread over tasks; every
    row still takes part in the result, and a key missed here costs time, not rows.
    """
    names = [keys] if isinstance(keys, str) else list(keys)
    if min_rows is None:
        min_rows = frequent_rows(df.sparkSession)
    share = min(1.0, _SAMPLE_ROWS / max(min_rows, 1))
    rows = df if share == 1.0 else df.sample(share, seed=7)
    key = F.col(names[0]) if len(names) == 1 else F.xxhash64(*names)
    found = (
        rows.select(key.alias("_k"))
        .groupBy("_k")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > min_rows * share)
        .orderBy(F.desc("_n"), "_k")
        .limit(4 * slots(df.sparkSession))
    )
    return [r["_k"] for r in found.collect()]


def is_frequent(keys: Sequence[str], frequent: Sequence) -> Column:
    key = F.col(keys[0]) if len(keys) == 1 else F.xxhash64(*keys)
    values = [v for v in frequent if v is not None]
    listed = F.coalesce(key.isin(values), F.lit(False)) if values else F.lit(False)
    return listed | key.isNull() if len(values) < len(frequent) else listed


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    frequent: Sequence | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """Join ``left`` with ``right`` (unique by ``on``), spreading frequent keys over many tasks.

    Rows of a frequent key get a salt from their place, and the single matching row of
    ``right`` is copied once per salt.  Rows with a frequent null key find no match but are
    spread as well.  Without frequent keys this is the plain join.  Several key columns must
    have the same types on both sides.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how not in ("left", "inner"):
        raise ValueError(f"lookup supports left and inner, got {how!r}")
    if frequent is None:
        frequent = frequent_keys(left, keys, min_rows)
    if not frequent:
        return left.join(right, keys, how).select(*left.columns, *[c for c in right.columns if c not in keys])

    width = slots(left.sparkSession)
    hot = is_frequent(keys, frequent)
    # A row number in its partition: reads no column, and spreads equal rows as well.
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(width)).cast("int")
    salted = left.withColumn("_salt", F.when(hot, salt).otherwise(F.lit(0)))
    last = F.when(hot, F.lit(width - 1)).otherwise(F.lit(0))
    copied = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
    joined = salted.join(copied, [*keys, "_salt"], how)
    return joined.select(*left.columns, *[c for c in right.columns if c not in keys])


def _numbered(df: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    """``df`` range-sorted by ``order`` and saved with ``_part`` and 0-based ``_row`` columns."""
    parts = slots(df.sparkSession)
    # The trailing id splits groups of rows that are equal in every ordering column.
    spread = df.withColumn("_copy", F.monotonically_increasing_id())
    by = [*order, F.col("_copy")]
    placed = (
        spread.repartitionByRange(parts, *by)
        .sortWithinPartitions(*by)
        .drop("_copy")
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33).cast("int"))
        .withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_id")
    )
    return save_shared(placed, label)


def _before(numbered: DataFrame, amount: Column) -> list:
    """What all earlier partitions add up to, by partition number: ``slots`` values at most."""
    totals = {r["_part"]: r["_t"] for r in numbered.groupBy("_part").agg(amount.alias("_t")).collect()}
    before, total = [], 0
    for part in range(max(totals, default=0) + 1):
        before.append(total)
        total += totals.get(part) or 0
    return before


def global_index(df: DataFrame, order: Sequence[Column], index: str = "idx") -> DataFrame:
    """1-based position of every row in ``order`` over the whole table.

    Range partitions are numbered independently; only one row count per partition is summed
    up by the driver and travels with the plan as a constant.
    """
    numbered = _numbered(df, order, "index")
    before = F.lit(_before(numbered, F.count(F.lit(1)))).cast("array<bigint>")
    place = F.get(before, F.col("_part")) + F.col("_row") + 1
    return numbered.withColumn(index, place).drop("_part", "_row")


def row_index(df: DataFrame, index: str = "idx") -> DataFrame:
    """A dense 1-based number of every row, in no particular order: the table is written once where it
    stands, and one row count per partition is added up.  No row is exchanged or sorted."""
    placed = df.withColumn("_id", F.monotonically_increasing_id())
    numbered = save_shared(placed.withColumn("_part", F.shiftright("_id", 33).cast("int")), "rows")
    before = F.lit(_before(numbered, F.count(F.lit(1)))).cast("array<bigint>")
    place = F.get(before, F.col("_part")) + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.withColumn(index, place).drop("_part", "_id")


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """Inclusive running totals ``{source column: output column}`` over the whole table in ``order``."""
    numbered = _numbered(df, order, "running")
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    out = numbered.select("*", *[F.sum(src).over(inside).alias(dst) for src, dst in sums.items()])
    for src, dst in sums.items():
        before = F.lit(_before(numbered, F.sum(src)))
        kind = f"array<{out.schema[dst].dataType.simpleString()}>"
        out = out.withColumn(dst, F.col(dst) + F.get(before.cast(kind), F.col("_part")))
    return out.drop("_part", "_row")


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    pos: str = "pos",
    total: str | None = None,
    frequent: Sequence | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """1-based position of each row inside its group, and the group size if ``total`` is named.

    Ordinary groups use one window (a single shuffle by key that later steps reuse).
    Frequent groups are range-sorted together over all tasks; their position is the row
    number in the partition plus the rows of the group in earlier partitions, taken from a
    table of at most one row per group and partition touched.
    """
    keys = list(keys)
    if frequent is None:
        frequent = frequent_keys(df, keys, min_rows)
    if not frequent:
        return _window_positions(df, keys, order, pos, total)

    hot = is_frequent(keys, frequent)
    numbered = _numbered(df.filter(hot), [*[F.col(k) for k in keys], *order], "positions")
    pieces = numbered.groupBy("_part", *keys).agg(F.min("_row").alias("_start"), F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        F.col("_part").alias("_p"),
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        "_start",
        F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_c").over(Window.partitionBy(*keys)).alias("_total"),
    )
    match = F.col("_part") == F.col("_p")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    placed = numbered.join(F.broadcast(pieces), match).withColumn(
        pos, F.col("_row") - F.col("_start") + F.col("_before") + 1
    )
    if total:
        placed = placed.withColumn(total, F.col("_total"))
    columns = [*df.columns, pos, *([total] if total else [])]
    cold = _window_positions(df.filter(~hot), keys, order, pos, total)
    return cold.select(*columns).unionByName(placed.select(*columns))


def _window_positions(
    df: DataFrame, keys: list[str], order: Sequence[Column], pos: str, total: str | None
) -> DataFrame:
    group = Window.partitionBy(*keys)
    out = df.withColumn(pos, F.row_number().over(group.orderBy(*order)).cast("long"))
    return out.withColumn(total, F.count(F.lit(1)).over(group)) if total else out
