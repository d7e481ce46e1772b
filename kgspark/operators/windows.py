"""Window verb over explicit groups and orders, safe for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.operators import ordered


def window(
    df: DataFrame,
    operation: str,
    to: str,
    order: Sequence[str],
    column: str | None = None,
    keys: Sequence[str] = (),
    positional: bool = False,
    limit: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Add one window column. ``order`` must be total for all but the rank family.

    ``positional`` gives the running count of non-null values of ``column`` for
    the rank family, the definition without ties.
    """
    if operation == "uuid":
        return df.withColumn(to, F.md5(F.concat_ws("\u0001", *[F.col(k).cast("string") for k in [*keys, *order]])))
    if operation in ("row_number", "rank", "percent_rank", "cume_dist") and positional:
        return _positional(df, operation, to, order, column, keys, limit, block_rows)
    if operation == "row_number":
        return ordered.row_numbers(df, to, keys, order, limit, block_rows)
    if operation in ("rank", "percent_rank", "cume_dist"):
        return _ranked(df, operation, to, order, keys, limit, block_rows)
    if operation in ("first_value", "last_value"):
        return _edge(df, operation, to, order, column, keys, limit)
    if operation in ("fill_down", "fill_up"):
        return ordered.fill(df, column, to, keys, order, operation[5:], limit, block_rows)
    raise ValueError(f"unknown window operation: {operation}")


def _positional(df, operation, to, order, column, keys, limit, block_rows):
    seen = F.col(column).isNotNull().cast("long")
    out = ordered.running_sums(df, {to: seen}, keys, order, limit, block_rows)
    if operation in ("row_number", "rank"):
        return out
    sizes = df.groupBy(*keys).agg(F.sum(seen).alias("__n"))
    out = ordered._null_safe_join(out, sizes, keys, few=not keys)
    n = F.col("__n").cast("double")
    ratio = F.col(to) / n if operation == "cume_dist" else F.try_divide(F.col(to) - 1, n - 1)
    return out.withColumn(to, ratio).drop("__n")


def _ranked(df, operation, to, order, keys, limit, block_rows):
    """Ranks with ties. Large groups are ranked over their distinct values, then joined back."""
    cold, hot, _ = ordered.split_hot(df, keys, limit)
    parts = []
    if cold is not None:
        w = Window.partitionBy(*keys).orderBy(*[F.col(o).asc_nulls_last() for o in order])
        raw = {"rank": F.rank(), "percent_rank": F.percent_rank(), "cume_dist": F.cume_dist()}[operation].over(w)
        parts.append(cold.withColumn(to, raw.cast("long") if operation == "rank" else raw))
    if hot is not None:
        counts = hot.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("__n"))
        upto = ordered.running_sums(counts, {"__upto": F.col("__n")}, keys, order, limit, block_rows)
        sizes = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
        upto = ordered._null_safe_join(upto, sizes, keys)
        before = F.col("__upto") - F.col("__n")
        value = {
            "rank": before + 1,
            "percent_rank": F.coalesce(F.try_divide(before.cast("double"), F.col("__total") - 1), F.lit(0.0)),
            "cume_dist": F.col("__upto") / F.col("__total").cast("double"),
        }[operation]
        names = [*keys, *order]
        looked = upto.select(*[F.col(n).alias(f"__r_{n}") for n in names], value.alias(to))
        cond = F.lit(True)
        for n in names:
            cond = cond & F.col(n).eqNullSafe(F.col(f"__r_{n}"))
        parts.append(hot.join(looked, cond).select(*df.columns, to))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _edge(df, operation, to, order, column, keys, limit):
    """First / last value of the group, by one map-side combined aggregate when it is large."""
    first = operation == "first_value"
    cold, hot, _ = ordered.split_hot(df, keys, limit)
    parts = []
    if cold is not None:
        orders = [F.col(o).asc_nulls_last() for o in order]
        w = Window.partitionBy(*keys).orderBy(*orders)
        frame = w.rowsBetween(Window.unboundedPreceding, 0) if first else w.rowsBetween(0, Window.unboundedFollowing)
        parts.append(cold.withColumn(to, (F.first if first else F.last)(column).over(frame)))
    if hot is not None:
        position = F.struct(*[s for o in order for s in (F.col(o).isNull(), F.col(o))])
        ends = hot.groupBy(*keys).agg((F.min_by if first else F.max_by)(F.col(column), position).alias(to))
        if keys:
            renamed = ends.withColumnsRenamed({k: f"__r_{k}" for k in keys})
            cond = F.lit(True)
            for k in keys:
                cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
            # one row per large group, and those are few
            parts.append(hot.join(F.broadcast(renamed), cond).select(*df.columns, to))
        else:
            parts.append(hot.join(F.broadcast(ends)).select(*df.columns, to))  # one row
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
