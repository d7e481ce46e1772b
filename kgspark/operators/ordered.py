"""Running values over ordered groups of any size.

A plain window puts a whole group into one task. Here the group sizes are
looked at first (one map-side combined count). Groups under the limit take the
plain window, one shuffle. Larger ones are range-partitioned by (group, order)
into blocks, each block is worked on alone, and one short summary per block
carries the running state over the block border. Both ways give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark import config
from kgspark.session import stored

BLOCK = "__block"
# Groups are counted in this many buckets first, and one by one only in buckets over the limit.
COUNT_BUCKETS = 1 << 16
# With more buckets over the limit than this, all groups are counted one by one.
MANY_BUCKETS = 1000


def split_hot(
    df: DataFrame, keys: Sequence[str], limit: int | None = None
) -> tuple[DataFrame | None, DataFrame | None, int]:
    """Split ``df`` into (groups that fit one task, larger groups, rows of the latter).

    At most total/limit groups can be larger than the limit, so the list of
    them is small enough to broadcast.
    """
    limit = limit or config.HOT_GROUP_ROWS
    if not keys:
        # one group: always in blocks, so that no task gets all rows
        rows = df.count()
        return (df, None, 0) if rows == 0 else (None, df, rows)
    # a large group lies in a bucket at least as large; the buckets' counts combine before the shuffle, however many groups there are
    bucket = F.pmod(F.xxhash64(*keys), F.lit(COUNT_BUCKETS))
    full = df.groupBy(bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).collect()
    if not full:
        return df, None, 0
    seen = df.filter(bucket.isin([r["__b"] for r in full])) if len(full) <= MANY_BUCKETS else df
    big = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).collect()
    if not big:
        return df, None, 0
    rows = sum(r["__n"] for r in big)
    schema = df.select(*keys).schema
    listed = df.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in big], schema)
    for k in keys:
        listed = listed.withColumnRenamed(k, f"__hot_{k}")
    same = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__hot_{k}"))
        same = c if same is None else same & c
    hot = df.join(F.broadcast(listed), same, "left_semi")
    cold = df.join(F.broadcast(listed), same, "left_anti")
    return cold, hot, rows


def _blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows: int, block_rows: int) -> DataFrame:
    n = max(2, math.ceil(rows / block_rows))
    ranged = df.repartitionByRange(n, *[F.col(k).asc() for k in keys], *order)
    return stored(ranged.withColumn(BLOCK, F.spark_partition_id()))


def _null_safe_join(left: DataFrame, right: DataFrame, names: Sequence[str], few: bool = True) -> DataFrame:
    """Left join on keys that may be null; ``few`` says the right side is bounded by the hot groups' blocks."""
    renamed = right
    for k in names:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    if not names:
        return left.join(F.broadcast(right))  # one row
    cond = F.lit(True)
    for k in names:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(F.broadcast(renamed) if few else renamed, cond, "left").drop(*[f"__r_{k}" for k in names])


def _as_orders(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]


def running_sums(
    df: DataFrame,
    sums: dict[str, Column],
    keys: Sequence[str],
    order: Sequence[str | Column],
    limit: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Add, per item of ``sums``, the inclusive running sum inside each group.

    ``order`` must be total inside a group.
    """
    orders = _as_orders(order)
    whole = Window.partitionBy(*keys).orderBy(*orders).rowsBetween(Window.unboundedPreceding, 0)
    cold, hot, rows = split_hot(df, keys, limit)
    parts = []
    if cold is not None:
        parts.append(cold.withColumns({to: F.sum(c).over(whole) for to, c in sums.items()}))
    if hot is not None:
        parts.append(_running_sums_blocked(hot, sums, keys, orders, rows, block_rows or config.BLOCK_ROWS))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _running_sums_blocked(df, sums, keys, orders, rows, block_rows):
    values = {f"__v_{to}": c for to, c in sums.items()}
    blocked = _blocks(df.withColumns(values), keys, orders, rows, block_rows)
    in_block = Window.partitionBy(*keys, BLOCK).orderBy(*orders).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(*keys, BLOCK).agg(*[F.sum(f"__v_{to}").alias(f"__t_{to}") for to in sums])
    offsets = totals.select(
        *keys, BLOCK, *[F.sum(f"__t_{to}").over(before).alias(f"__o_{to}") for to in sums]
    )
    local = blocked.withColumns({f"__l_{to}": F.sum(f"__v_{to}").over(in_block) for to in sums})
    joined = _null_safe_join(local, offsets, [*keys, BLOCK])
    # null only while nothing was added yet, as a plain running sum has it
    final = {
        to: F.when(
            F.col(f"__l_{to}").isNotNull() | F.col(f"__o_{to}").isNotNull(),
            F.coalesce(f"__l_{to}", F.col(f"__o_{to}") * 0) + F.coalesce(f"__o_{to}", F.col(f"__l_{to}") * 0),
        )
        for to in sums
    }
    return joined.select(*df.columns, *[c.alias(to) for to, c in final.items()])


def row_numbers(
    df: DataFrame,
    to: str,
    keys: Sequence[str],
    order: Sequence[str | Column],
    limit: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """1-based position in each group, 64-bit."""
    orders = _as_orders(order)
    cold, hot, rows = split_hot(df, keys, limit)
    parts = []
    if cold is not None:
        w = Window.partitionBy(*keys).orderBy(*orders)
        parts.append(cold.withColumn(to, F.row_number().over(w).cast("long")))
    if hot is not None:
        parts.append(_row_numbers_blocked(hot, to, keys, orders, rows, block_rows or config.BLOCK_ROWS))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _row_numbers_blocked(df, to, keys, orders, rows, block_rows):
    """One shuffle: a block is sorted where it lies, and its rows are counted through as they are written."""
    n = max(2, math.ceil(rows / block_rows))
    ranged = df.repartitionByRange(n, *[F.col(k).asc() for k in keys], *orders)
    lying = ranged.sortWithinPartitions(*[F.col(k).asc() for k in keys], *orders)
    at = stored(lying.withColumn("__at", F.monotonically_increasing_id()))
    # the number of the task is in the upper 31 bits, the row's in the others
    blocked = at.withColumns({BLOCK: F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    groups = blocked.groupBy(*keys, BLOCK).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    carried = F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long")) - F.col("__first") + 1
    joined = _null_safe_join(blocked, groups.select(*keys, BLOCK, carried.alias("__add")), [*keys, BLOCK])
    return joined.select(*df.columns, (F.col("__at") + F.col("__add")).alias(to))


def fill(
    df: DataFrame,
    column: str,
    to: str,
    keys: Sequence[str],
    order: Sequence[str],
    direction: str = "down",
    limit: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Nearest non-null value at or before (``down``) / at or after (``up``) each row."""
    down = direction == "down"
    orders = [F.col(o).asc_nulls_last() if down else F.col(o).desc_nulls_first() for o in order]
    cold, hot, rows = split_hot(df, keys, limit)
    whole = Window.partitionBy(*keys).orderBy(*orders).rowsBetween(Window.unboundedPreceding, 0)
    parts = []
    if cold is not None:
        parts.append(cold.withColumn(to, F.last(column, ignorenulls=True).over(whole)))
    if hot is not None:
        blocked = _blocks(hot, keys, orders, rows, block_rows or config.BLOCK_ROWS)
        in_block = Window.partitionBy(*keys, BLOCK).orderBy(*orders).rowsBetween(Window.unboundedPreceding, 0)
        before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        local = blocked.withColumn("__local", F.last(column, ignorenulls=True).over(in_block))
        position = F.struct(*[x for o in order for x in (F.col(o).isNull(), F.col(o))])
        pick = F.max_by if down else F.min_by
        seen = F.col(column).isNotNull()
        ends = blocked.groupBy(*keys, BLOCK).agg(
            pick(F.when(seen, F.col(column)), F.when(seen, position)).alias("__end")
        )
        carried = ends.select(*keys, BLOCK, F.last("__end", ignorenulls=True).over(before).alias("__carry"))
        joined = _null_safe_join(local, carried, [*keys, BLOCK])
        parts.append(joined.select(*df.columns, F.coalesce("__local", "__carry").alias(to)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def quantiles(
    df: DataFrame,
    column: str,
    probabilities: dict[str, float],
    keys: Sequence[str] = (),
    limit: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group.

    Equal values are counted first, so the work after the map side grows with
    the distinct values and no group is held in one buffer.
    """
    value = F.col(column).cast("double")
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(*keys, value.alias("__x"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    upto = running_sums(counts, {"__upto": F.col("__n")}, keys, ["__x"], limit, block_rows)
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    placed = _null_safe_join(upto, totals, keys, few=not keys)
    picks = []
    for name, p in probabilities.items():
        at = F.lit(float(p)) * (F.col("__total") - 1)
        picks.append(F.min(F.when(F.col("__upto") - 1 >= F.floor(at), F.col("__x"))).alias(f"__lo_{name}"))
        picks.append(F.min(F.when(F.col("__upto") - 1 >= F.ceil(at), F.col("__x"))).alias(f"__hi_{name}"))
    grouped = placed.groupBy(*keys).agg(F.first("__total").alias("__total"), *picks)
    out = []
    for name, p in probabilities.items():
        at = F.lit(float(p)) * (F.col("__total") - 1)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return grouped.select(*keys, *out)


def collect_pages(
    df: DataFrame,
    value: Column,
    to: str,
    keys: Sequence[str],
    order: Sequence[str | Column],
    page_rows: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Ordered array per group, nulls kept, cut into rows of at most ``page_rows`` items.

    Adds ``page`` (0-based). A group no longer than a page gives one row, as an
    ordinary collected array would; a longer one goes on in further rows.
    """
    page_rows = page_rows or config.PAGE_ROWS
    numbered = row_numbers(df.withColumn("__item", value), "__rn", keys, order, limit)
    paged = numbered.withColumn("page", F.floor((F.col("__rn") - 1) / page_rows).cast("long"))
    packed = F.sort_array(F.collect_list(F.struct(F.col("__rn"), F.col("__item"))))
    return paged.groupBy(*keys, "page").agg(F.transform(packed, lambda s: s["__item"]).alias(to))


def in_pages(size: Column, page_rows: int, cut: Callable[[Column], Column]) -> Column:
    """Rows (page, item) of an array of ``size`` items; ``cut`` makes the item of the page that starts at a position."""
    starts = F.sequence(F.lit(0), F.floor((F.greatest(size, F.lit(1)) - 1) / page_rows).cast("int"))
    return F.inline(
        F.transform(starts, lambda i: F.struct(i.cast("long").alias("page"), cut(i * page_rows + 1).alias("item")))
    )


def set_pages(
    df: DataFrame,
    values: Sequence[str],
    item: Callable[..., Column],
    to: str,
    keys: Sequence[str],
    page_rows: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Distinct items per group in order, nulls last, cut into pages as by ``collect_pages``.

    ``item`` makes an item out of the columns ``values``. These travel, and the
    items are made where the group is put together. A group of more rows than
    a cell may hold is numbered.
    """
    page_rows = page_rows or config.PAGE_ROWS
    cell = limit or config.PAGE_ROWS
    rows = df.select(*keys, *values)
    cold, hot, _ = split_hot(rows, keys, cell)
    parts = []
    if cold is not None:
        made = F.transform(F.collect_set(F.struct(*values)), lambda s: item(*[s[v] for v in values]))
        sets = cold.groupBy(*keys).agg(F.array_sort(F.array_distinct(made)).alias("__items"))
        if page_rows >= cell:
            parts.append(sets.select(*keys, F.lit(0).cast("long").alias("page"), F.col("__items").alias(to)))
        else:
            pages = in_pages(F.size("__items"), page_rows, lambda at: F.slice("__items", at, page_rows))
            parts.append(sets.select(*keys, pages).withColumnRenamed("item", to))
    if hot is not None:
        named = hot.select(*keys, item(*[F.col(v) for v in values]).alias("__value")).distinct()
        parts.append(collect_pages(named, F.col("__value"), to, keys, ["__value"], page_rows))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
