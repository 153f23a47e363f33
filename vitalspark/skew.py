"""Group-wise building blocks that stay spread out when one key is very large.

``first_rows``      top rows per group; map tasks keep at most k rows per group
``row_positions``   1-based position of every row in its group, numbered slice by slice
``rolling_rows``    aggregate over the last n rows of a group, in fixed-size blocks
``join_optional``   left join whose null keys do not pile up in one task
``position_parts`` documents cut into parts of so many positions, alike at every size
``split_large``    rows of groups that fit in one task, and rows of the few that don't
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

NULL_SPREAD = 256
BLOCK_ROWS = 4096
PART_ROWS = 10_000


def same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Null-safe equality on shared column names."""
    return reduce(
        lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns], F.lit(True)
    )


def join_shared(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inner join on shared columns, nulls equal; the right side may come from the left one."""
    named = right.select(
        *[F.col(c).alias(f"_k_{c}") for c in columns], *[c for c in right.columns if c not in columns]
    )
    on = reduce(lambda a, b: a & b, [left[c].eqNullSafe(named[f"_k_{c}"]) for c in columns], F.lit(True))
    return left.join(named, on).drop(*[f"_k_{c}" for c in columns])


def first_rows(df: DataFrame, keys: Sequence, order: Sequence[Column], rows: int = 1) -> DataFrame:
    """The first ``rows`` rows of each group.

    A ``row_number`` bound of this form is cut on the map side before the shuffle
    (WindowGroupLimit), so a huge group sends ``rows`` rows per map task.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= rows).drop("_place")


def row_positions(
    df: DataFrame,
    keys: Sequence[str],
    slice_by: Column,
    order: Sequence[Column],
    *,
    descending: bool = False,
    null_groups: bool = True,
    name: str = "position",
) -> DataFrame:
    """Number the rows of each group without sorting a whole group in one task.

    ``slice_by`` must agree with ``order``: all rows of a slice come before those of
    the next. Each slice is numbered alone; counts per slice give its starting point.
    The running sum sees one row per slice, so slices should be calendar periods or the
    like. With ``null_groups=False`` rows with a null key or slice are left out, and the
    counts meet the rows where the numbering put them, without another shuffle.
    """
    sliced = df.withColumn("_slice", slice_by)
    by = [*keys, "_slice"]
    numbered = sliced.withColumn(
        "_in_slice", F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    )
    sizes = sliced.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    ordered = F.col("_slice").desc_nulls_last() if descending else F.col("_slice").asc_nulls_first()
    before = Window.partitionBy(*keys).orderBy(ordered).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    starts = starts.select(*[F.col(c).alias(f"_s_{c}") for c in by], "_before")
    pairs = [(numbered[c], starts[f"_s_{c}"]) for c in by]
    on = reduce(
        lambda a, b: a & b, [a.eqNullSafe(b) if null_groups else a == b for a, b in pairs]
    )
    return numbered.join(starts, on).select(
        *[numbered[c] for c in df.columns], (F.col("_before") + F.col("_in_slice")).alias(name)
    )


def rolling_rows(
    df: DataFrame,
    keys: Sequence[str],
    slice_by: Column,
    order: Sequence[Column],
    rows: int,
    measure: Callable[[WindowSpec], Column],
    name: str,
    block_rows: int = BLOCK_ROWS,
    null_groups: bool = True,
) -> DataFrame:
    """``measure(window)`` over the current and the ``rows - 1`` rows before it.

    Rows are cut into blocks by position; the tail of a block is also handed to the
    next block, so every window sees all it needs and no task holds a whole group.
    """
    back = rows - 1
    if not 0 <= back < block_rows:
        raise ValueError("block_rows must exceed the window")
    placed = row_positions(
        df, keys, slice_by, order, null_groups=null_groups, name="_position"
    )
    home = F.floor((F.col("_position") - 1) / block_rows)
    in_tail = (F.col("_position") - 1) % block_rows >= block_rows - back
    copies = placed.withColumn("_home", home).withColumn(
        "_block",
        F.explode(F.when(in_tail, F.array(home, home + 1)).otherwise(F.array(home))),
    )
    window = Window.partitionBy(*keys, "_block").orderBy("_position").rowsBetween(-back, 0)
    return (
        copies.withColumn(name, measure(window))
        .filter(F.col("_block") == F.col("_home"))
        .select(*df.columns, name)
    )


def join_optional(
    left: DataFrame,
    right: DataFrame,
    left_keys: str | Sequence[str],
    right_keys: str | Sequence[str],
    spread_by: Sequence[str],
) -> DataFrame:
    """Left join on nullable keys; ``right_keys`` are dropped from the result.

    Rows without a full key match nothing, so they are dealt over many hash values
    instead of all meeting in the task that owns null. A hot key is left to the adaptive
    skew split: the extra join column makes Spark shuffle both sides for this join alone,
    which the split needs, even where the right side was grouped by the same key. A right
    side of small measured size is broadcast by Spark.
    """
    ours = [left_keys] if isinstance(left_keys, str) else list(left_keys)
    theirs = [right_keys] if isinstance(right_keys, str) else list(right_keys)
    unmatched = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in ours])
    spread = F.when(unmatched, F.pmod(F.xxhash64(*spread_by), F.lit(NULL_SPREAD))).otherwise(0)
    dealt = left.withColumn("_spread", spread.cast("int"))
    # always 0, but not a constant, so that it stays part of the join key
    target = right.withColumn("_target", F.pmod(F.xxhash64(*theirs), F.lit(1)).cast("int"))
    on = dealt["_spread"] == target["_target"]
    for a, b in zip(ours, theirs):
        on = on & (dealt[a] == target[b])
    joined = dealt.join(target, on, "left")
    for b in theirs:
        joined = joined.drop(target[b])
    return joined.drop("_spread", "_target")


def position_parts(
    rows: DataFrame, keys: Sequence[str], slice_by: Column, order: Sequence[Column],
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Add ``place``, the position in the document of ``keys``, and ``part``, its block of positions.

    Parts of a document in order of ``part``, each ordered by ``place``, are the whole
    document in order, whatever ``part_rows`` is.
    """
    placed = row_positions(rows, keys, slice_by, order, name="place")
    return placed.withColumn("part", F.floor((F.col("place") - 1) / part_rows).cast("int"))


def split_large(rows: DataFrame, keys: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """The rows of groups of at most ``limit`` rows, and those of larger groups.

    Sizes come from a partial aggregate, and the larger groups are few: ``limit`` rows stand
    behind each. Small groups fit in one task and can be collected at once.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    large = sizes.select(*[F.col(k).alias(f"_l_{k}") for k in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_l_{k}")) for k in keys], F.lit(True))
    return rows.join(large, on, "left_anti"), rows.join(large, on, "left_semi")
