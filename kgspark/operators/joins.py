"""Join verb. The physical join is left to Catalyst and AQE, which check sizes and split skew."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark import config

_HOW = {
    "inner": "inner",
    "left outer": "left",
    "right outer": "right",
    "full outer": "full",
    "cross": "cross",
    "anti join": "left_anti",
    "semi join": "left_semi",
}


def is_small(df: DataFrame, rows: int | None = None) -> bool:
    """True when ``df`` has at most ``rows`` rows; reads no more than needed to tell."""
    rows = rows or config.BROADCAST_ROWS
    return df.limit(rows + 1).count() <= rows


def join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | None = None,
    strategy: str = "inner",
    null_safe: bool = False,
) -> DataFrame:
    """Join two tables.

    ``on`` is ``[left_column, right_column]``, one shared name, or None for all
    shared names. Other columns both tables have get ``_1`` and ``_2``.
    """
    how = _HOW[strategy]
    if how == "cross":
        return _cross(left, right)
    if not on:
        pairs = [(c, c) for c in left.columns if c in right.columns]
        if not pairs:
            raise ValueError("no shared columns to join on")
    elif len(on) == 1:
        pairs = [(on[0], on[0])]
    else:
        pairs = [(on[0], on[1])]

    if how in ("left_semi", "left_anti"):
        keys = right.select(*[F.col(r).alias(f"__r_{r}") for _, r in pairs])
        return left.join(keys, _condition(pairs, null_safe), how)

    merged = {l for l, r in pairs if l == r}
    clash = [c for c in left.columns if c in right.columns and c not in merged]
    left = left.withColumnsRenamed({c: f"{c}_1" for c in clash})
    right = right.withColumnsRenamed({c: f"{c}_2" for c in clash})
    pairs = [(f"{l}_1" if l in clash else l, f"{r}_2" if r in clash else r) for l, r in pairs]
    kept = [c for c in right.columns if c not in merged]
    names = [*left.columns, *kept]
    right_keyed = right.withColumns({f"__r_{r}": F.col(r) for _, r in pairs}).drop(*merged)
    condition = _condition(pairs, null_safe)
    if how != "full":
        joined = left.join(right_keyed, condition, how)
        return _named(joined, pairs, names, merged, how)
    # a full join cannot be split when skewed; left join plus unmatched right rows can
    both = _named(left.join(right_keyed, condition, "left"), pairs, names, merged, "left")
    left_keys = left.select(*[F.col(l) for l, _ in pairs])
    alone = right_keyed.join(left_keys, condition, "left_anti")
    extra = alone.select(
        *[
            F.col(f"__r_{c}").alias(c)
            if c in merged
            else (F.col(c) if c in kept else F.lit(None).cast(left.schema[c].dataType).alias(c))
            for c in names
        ]
    )
    return both.unionByName(extra)


def _condition(pairs, null_safe):
    cond = None
    for l, r in pairs:
        a, b = F.col(l), F.col(f"__r_{r}")
        c = a.eqNullSafe(b) if null_safe else a == b
        cond = c if cond is None else cond & c
    return cond


def _named(joined, pairs, names, merged, how):
    if how == "right":
        joined = joined.withColumns({c: F.col(f"__r_{c}") for c in merged})
    return joined.select(*names)


def text_bytes(df: DataFrame) -> int:
    """Bytes of the values whose length is not fixed."""
    sizes = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.octet_length(c))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            sizes.append(F.octet_length(F.to_json(F.struct(c))))
    if not sizes:
        return 0
    total = sum((F.coalesce(s.cast("long"), F.lit(0)) for s in sizes), F.lit(0))
    return df.agg(F.sum(total)).first()[0] or 0


def _cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair. A side of few rows and little text goes to every task; two larger ones meet in a grid.

    Few rows can hold long texts, and a broadcast passes the driver whole: so the bytes count too.
    """
    clash = [c for c in left.columns if c in right.columns]
    left = left.withColumnsRenamed({c: f"{c}_1" for c in clash})
    right = right.withColumnsRenamed({c: f"{c}_2" for c in clash})
    counts = [df.limit(config.BROADCAST_ROWS + 1).count() for df in (left, right)]
    # the side of fewer rows first: it is the one whose texts are quickly measured
    for side in sorted((1, 0), key=lambda s: counts[s]):
        df = (left, right)[side]
        if counts[side] <= config.BROADCAST_ROWS and text_bytes(df) <= config.BROADCAST_BYTES:
            return left.crossJoin(F.broadcast(df)) if side else F.broadcast(df).crossJoin(right)
    return _grid(left, right)


def _grid(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of two large sides: rows are dealt into blocks, and each pair of blocks is a key.

    A row goes once to every block of the other side, so no task holds more than a block of each.
    """
    rows, columns = (
        max(1, math.ceil(df.count() / config.GRID_ROWS), math.ceil(text_bytes(df) / config.GRID_BYTES)) for df in (left, right)
    )

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        mine = F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
        return df.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    a, b = dealt(left, "__row", rows, "__column", columns), dealt(right, "__column", columns, "__row", rows)
    return a.join(b, ["__row", "__column"]).drop("__row", "__column")


def id_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only, with the side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only_a = a.join(b, key, "left_anti").withColumn("side", F.lit("left"))
    only_b = b.join(a, key, "left_anti").withColumn("side", F.lit("right"))
    return only_a.unionByName(only_b)
