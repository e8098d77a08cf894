"""Skew-safe ordered computations: running sums, row numbers and lags per group.

``Window.partitionBy(g).orderBy(o)`` sends a whole group to one task, and a global
``Window.orderBy(o)`` sends the whole table to one task.  Where one key may hold a
third of the rows, that task becomes the job.  ``ordered_scan`` instead:

1. range-partitions on ``(group keys, order keys)``, so a hot group is cut into many
   ranges (sampled bounds), and tags every row with its range;
2. runs the engine's own window per (range, group), which is bounded by the range, and
   writes the result once as Parquet in the shared checkpoint folder;
3. builds a carry table with one row per range (the last group's running totals and
   last values) and broadcasts it -- its size is bounded by the number of ranges, not by
   the data -- to finish the groups that cross a boundary.

Columns never leave the JVM, so every type passes through unchanged.  The caller must
give a *total* order (add a unique key as the last order column) so the result does not
depend on how ties happen to be split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

_RANGE, _ROW, _SIZE, _GROUP = "__range", "__row", "__size", "__g0"
_WHOLE = (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.BooleanType)


def _qc(name: str) -> Column:
    return F.col(f"`{name}`")


def ordered_scan(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], *,
                 row_number: str | None = None, running: dict[str, str] | None = None,
                 lags: dict[str, str] | None = None,
                 num_partitions: int | None = None) -> DataFrame:
    """Add row numbers, running sums and previous-row values within ``by`` groups.

    ``running`` maps output name -> numeric source column (sum includes the current
    row, NULL counts as 0; a long for whole numbers, else a double); ``lags`` maps output
    name -> source column (value of the previous row of the same group, NULL for the
    group's first row).  Equivalent to ``row_number()/sum()/lag() OVER (PARTITION BY by
    ORDER BY order)`` without the one-task-per-group hazard.

    The scan is written once, because the range partitioner samples with a seed tied to
    the plan: two evaluations could cut the ranges differently.
    """
    running, lags, by = dict(running or {}), dict(lags or {}), list(by)
    work = df
    if not by:
        work = work.withColumn(_GROUP, F.lit(0))
        by = [_GROUP]
    order_cols = [_qc(o) if isinstance(o, str) else o for o in order]
    group = [_qc(b) for b in by]
    keys = [*group, *order_cols]
    # without an explicit count, AQE may merge adjacent ranges of small data
    ranged = work.repartitionByRange(num_partitions, *keys) if num_partitions else work.repartitionByRange(*keys)
    ranged = ranged.withColumn(_RANGE, F.spark_partition_id())

    piece = Window.partitionBy(_RANGE, *group)
    ordered = piece.orderBy(*order_cols)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def number(src: str) -> Column:
        whole = isinstance(work.schema[src].dataType, _WHOLE)
        return F.coalesce(_qc(src).cast("long" if whole else "double"), F.lit(0).cast("long" if whole else "double"))

    local = materialize(ranged.select(
        "*", F.row_number().over(ordered).cast("long").alias(_ROW),
        *[F.sum(number(s)).over(so_far).alias(o) for o, s in running.items()],
        *[F.lag(_qc(s)).over(ordered).alias(o) for o, s in lags.items()],
        F.count(F.lit(1)).over(piece).alias(_SIZE)), "ordered-scan")

    # the last row of each range's last group: one row per range, so the windows over
    # these rows and the broadcast are bounded
    ends = local.where(F.col(_ROW) == F.col(_SIZE))
    last = ends.groupBy(_RANGE).agg(F.max(F.struct(*group)).alias("__last"))
    ends = ends.join(F.broadcast(last.withColumnRenamed(_RANGE, "__r")),
                     (F.col(_RANGE) == F.col("__r")) & (F.struct(*group).eqNullSafe(F.col("__last"))))
    same_group = Window.partitionBy(*group).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = ends.select(
        *[_qc(b).alias("__k_" + b) for b in by],
        F.lead(_RANGE).over(Window.orderBy(_RANGE)).alias("__next"),
        F.sum(_SIZE).over(same_group).alias("__off_row"),
        *[F.sum(_qc(o)).over(same_group).alias("__off_" + o) for o in running],
        *[_qc(s).alias("__val_" + o) for o, s in lags.items()],
    ).where(F.col("__next").isNotNull())
    cond = [F.col(_RANGE) == F.col("__next")] + [_qc(b).eqNullSafe(_qc("__k_" + b)) for b in by]
    joined = local.join(F.broadcast(carry), on=cond, how="left")

    out = [_qc(c) for c in work.columns if c != _GROUP]
    if row_number:
        out.append((F.col(_ROW) + F.coalesce("__off_row", F.lit(0))).alias(row_number))
    for o, s in running.items():
        out.append((_qc(o) + F.coalesce(_qc("__off_" + o), F.lit(0))).alias(o))
    for o in lags:
        out.append(F.when((F.col(_ROW) == 1) & F.col("__next").isNotNull(), _qc("__val_" + o)).otherwise(_qc(o)).alias(o))
    return joined.select(*out)


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k within each group.

    Written as ``row_number() <= k``: Spark plans a partial ``WindowGroupLimit``
    before the shuffle, so each map task forwards at most k rows per group and a
    hot group cannot overload the reducer.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
