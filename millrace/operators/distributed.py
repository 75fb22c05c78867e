"""Building blocks that keep one hot key, or one global order, from landing in a single task.

Window functions put a whole partition key into one task.  Where a key can hold a large share of
the rows and every row must keep its position, these helpers range-partition by the full sort key
instead, so a hot key is spread over many tasks and only one row per task is combined globally.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialize

_ROW_BITS = (1 << 33) - 1  # low bits of monotonically_increasing_id are the row number in the task


def range_sorted(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-partition and sort by ``order``, tag each row with task number and offset, persist."""
    tagged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_task", F.shiftright("_row", 33))
        .withColumn("_row", F.col("_row").bitwiseAND(_ROW_BITS))
    )
    return materialize(tagged)


def _task_offsets(per_task: DataFrame) -> DataFrame:
    """Sum of all earlier tasks.  Input has one row per task, so one unpartitioned window is safe."""
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    return per_task.select("_task", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))


BROADCAST_BYTES = 64 << 20


def _value_bytes(value) -> int:
    if isinstance(value, (list, tuple)):
        return 16 + sum(map(_value_bytes, value))
    return 16 + (len(value) if isinstance(value, (str, bytes, bytearray)) else 8)


def fits_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the counted ``rows`` times a measured row width stay within ``limit`` bytes."""
    return rows * max((_value_bytes(tuple(r)) for r in df.take(20)), default=0) <= limit


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only while the counted ``rows`` times a measured row width stay within ``limit`` bytes.

    The width is the widest of a few rows, so a table of long vectors is judged by its vectors; beyond the limit the
    join is shuffled.
    """
    return F.broadcast(df) if fits_broadcast(df, rows, limit) else df


PARTS = 16
PART_BYTES = 16 << 20


def part_count(rows: Column, row_bytes: Column, tile: int) -> Column:
    """Parts of a set whose parts all meet each other in pairs.

    Every row is sent to every part, so small parts would make what is sent grow with the square of the set.  There are
    no more than ``PARTS``, unless these exceed ``PART_BYTES``, and no more than parts of ``tile`` rows.
    """
    large = F.ceil(rows * row_bytes / F.lit(PART_BYTES))
    return F.least(F.ceil(rows / F.lit(tile)), F.greatest(F.lit(PARTS), large)).cast("int")


def ordered_index(df: DataFrame, *order: Column, name: str = "row_index") -> DataFrame:
    """Zero-based position of every row in the global order.

    ``order`` must end in a unique column: equal sort keys always share a task.
    """
    rows = range_sorted(df, order)
    offsets = _task_offsets(rows.groupBy("_task").agg(F.count("*").alias("_size")))
    return (
        rows.join(F.broadcast(offsets), "_task")  # one row per task
        .withColumn(name, F.col("_base") + F.col("_row"))
        .drop("_task", "_row", "_base")
    )


def running_totals(sorted_rows: DataFrame, amounts: Sequence[str]) -> DataFrame:
    """Add ``before_<amount>`` (exclusive running sum) to rows of :func:`range_sorted`; task and row stay."""
    inside = Window.partitionBy("_task").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    sums = sorted_rows.groupBy("_task").agg(*[F.sum(a).alias(f"_s_{a}") for a in amounts])
    offsets = sums.select("_task", *[F.coalesce(F.sum(f"_s_{a}").over(before), F.lit(0)).alias(f"_o_{a}") for a in amounts])
    joined = sorted_rows.join(F.broadcast(offsets), "_task")
    return joined.withColumns(
        {f"before_{a}": F.col(f"_o_{a}") + F.coalesce(F.sum(a).over(inside), F.lit(0)) for a in amounts}
    ).drop(*[f"_o_{a}" for a in amounts])


def running_total(df: DataFrame, order: Sequence[Column], amount: str) -> DataFrame:
    """Add ``total_before`` (exclusive running sum of ``amount``) in the global order."""
    rows = running_totals(range_sorted(df, order), [amount])
    return rows.withColumnRenamed(f"before_{amount}", "total_before").drop("_task", "_row")


def ordered_lag(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Previous row's ``columns`` (as ``prev_*``) within ``keys``, without a window over a hot key."""
    sort = [F.col(c) for c in (*keys, *order)]
    rows = ordered_index(df, *sort, name="_pos")  # rests on a checkpoint: cheap to read twice
    earlier = rows.select(
        (F.col("_pos") + 1).alias("_pos"),
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.col(c).alias(f"_p_{c}") for c in columns],
    )
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    joined = rows.join(earlier, "_pos", "left")
    return joined.select(
        *df.columns, *[F.when(same, F.col(f"_p_{c}")).alias(f"prev_{c}") for c in columns]
    )


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Occurrences of each distinct value; map-side combined, so a hot value costs one row."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("value"))
        .agg(F.count("*").alias("occurrences"))
    )


def exact_percentiles(
    df: DataFrame, value: str, fractions: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact percentiles with linear interpolation, one output column per fraction.

    Works on value counts in global order: no group is ever gathered, unlike ``percentile``.
    """
    counts = value_counts(df, value, by)
    order = [F.col(c) for c in (*by, "value")]
    ranked = running_total(counts, order, "occurrences")
    stats = [F.sum("occurrences").alias("n"), F.min("total_before").alias("base")]
    if by:
        located = ranked.join(ranked.groupBy(*by).agg(*stats), list(by))
    else:
        # A global aggregate is a single row: carry it as literals.
        row = ranked.agg(*stats).first()
        located = ranked.withColumns(
            {"n": F.lit(row["n"]).cast("long"), "base": F.lit(row["base"]).cast("long")}
        )
    start = F.col("total_before") - F.col("base")
    end = start + F.col("occurrences")
    aggregates = [F.max("n").alias("n")]
    for name, fraction in fractions.items():
        position = F.lit(float(fraction)) * (F.col("n") - 1)
        low = F.floor(position)
        high = F.least(low + 1, F.col("n") - 1)
        aggregates += [
            F.max(F.when((low >= start) & (low < end), F.col("value"))).alias(f"_lo_{name}"),
            F.max(F.when((high >= start) & (high < end), F.col("value"))).alias(f"_hi_{name}"),
        ]
    found = located.groupBy(*by).agg(*aggregates)
    columns = []
    for name, fraction in fractions.items():
        position = F.lit(float(fraction)) * (F.col("n") - 1)
        weight = position - F.floor(position)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        columns.append((low + (high - low) * weight).alias(name))
    return found.select(*by, F.col("n"), *columns)


def average_ranks(counts: DataFrame) -> DataFrame:
    """One-based average rank of each distinct value from its counts (ties share the mean rank)."""
    ranked = running_total(counts, [F.col("value")], "occurrences")
    rank = F.col("total_before") + (F.col("occurrences") + F.lit(1)) / F.lit(2.0)
    return ranked.select("value", rank.alias("average_rank"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Row with the smallest ``order`` per key through a combinable aggregate, not a window."""
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return chosen.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "position"
) -> DataFrame:
    """First ``k`` rows per key.  Catalyst turns this into a group limit before the shuffle, so a
    hot key contributes at most ``k`` rows per task."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def rank_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str = "position") -> DataFrame:
    """Rank of every row of its key: global order, then offset of the key, so a hot key is spread over tasks."""
    ordered = ordered_index(df, *[F.col(k) for k in keys], *order, name="_pos")
    first = materialize(ordered.groupBy(*keys).agg(F.min("_pos").alias("_first")))  # one row per key, for all readers
    return ordered.join(first, list(keys)).withColumn(rank, F.col("_pos") - F.col("_first") + 1).drop("_pos", "_first")
