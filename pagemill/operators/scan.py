"""Numbers and running sums along keys of any length, in two passes.

No window, task or group holds a whole key: rows are dealt by ranges of (key, order), each
range is summed by itself, and an exclusive sum over the few totals of keys that lie in
several ranges gives what a range has to add.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.plans.session import cut

#: Bytes of a range; at least spark.sql.shuffle.partitions ranges are made, and at most MOST.
RANGE, MOST = 64 << 20, 20_000


def ranges(df: DataFrame, each: int = RANGE) -> int:
    """How many ranges a frame is dealt into, by the sizes of what it reads (a leaf of unknown size counts as nothing)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(sum(s for s in sizes if s < 1 << 60) // each, MOST))


def dealt(df: DataFrame, by: list[str]) -> DataFrame:
    """The rows in ranges of ``by``, nulls first, sorted within; the ranges' bounds are sampled."""
    return df.repartitionByRange(ranges(df), *by).sortWithinPartitions(*by)


def laid_out(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows in ranges of (key, order), nulls first, written once; ``_id`` ascends with them and ``_part`` is the range.

    Equal rows are told apart by a number, so that a group of copies may span ranges too. ``df``
    should be a scan or a written table: the number must not change when a task runs again.
    """
    rows = dealt(df.withColumn("_row", F.monotonically_increasing_id()), [*key, *order, "_row"])
    return cut(rows.drop("_row").withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftrightunsigned("_id", 33)))


def running(df: DataFrame, key: list[str], order: list[str], sums: dict[str, Column], totals: dict[str, Column] | None = None) -> DataFrame:
    """The frame with inclusive sums along each key, and with sums over the whole key (``totals``).

    ``sums`` and ``totals`` name the new columns; a null counts as 0. A null key is a key; rows of
    the same key and order are summed in a fixed but arbitrary order. Column names that begin with ``_`` are the scan's own.
    """
    totals = totals or {}
    placed = laid_out(df, key, order)
    within = Window.partitionBy(*key, "_part")
    along = within.orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    none = lambda c: F.coalesce(c, F.lit(0))
    local = placed.select("*", *[F.sum(none(c)).over(along).alias(n) for n, c in sums.items()], *[F.sum(none(c)).over(within).alias(n) for n, c in totals.items()])
    part = placed.groupBy(*key, "_part").agg(*[F.sum(none(c)).alias(f"_s{i}") for i, c in enumerate(sums.values())], *[F.sum(none(c)).alias(f"_t{i}") for i, c in enumerate(totals.values())])
    # a key in several ranges is the last of one and the first of the next: at most two rows a range
    several = part.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    same = lambda a, b: [a[k].eqNullSafe(b[f"_k{i}"]) for i, k in enumerate(key)]
    several = several.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)])
    few = cut(part.join(several, same(part, several), "left_semi"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = few.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_part").alias("_p"),
        *[none(F.sum(f"_s{i}").over(before)).alias(f"_b{i}") for i in range(len(sums))],
        *[F.sum(f"_t{i}").over(Window.partitionBy(*key)).alias(f"_w{i}") for i in range(len(totals))],
    )
    j = local.join(F.broadcast(offsets), [*same(local, offsets), local["_part"] == offsets["_p"]], "left")
    return j.select(
        *df.columns,
        *[(F.col(n) + none(F.col(f"_b{i}"))).alias(n) for i, n in enumerate(sums)],
        *[F.coalesce(f"_w{i}", n).alias(n) for i, n in enumerate(totals)],
    )


def numbered(df: DataFrame, key: list[str], order: list[str], name: str = "pos", total: str | None = None) -> DataFrame:
    """The frame with each row's place in its key, from 0, and (``total``) how many rows the key has."""
    one = F.lit(1).cast("long")
    out = running(df, key, order, {name: one}, {total: one} if total else None)
    return out.withColumn(name, F.col(name) - 1)


def recurrence(df: DataFrame, key: list[str], order: list[str], value: str, name: str = "decoded", modulo: int = 256) -> DataFrame:
    """x[i] = (x[i-1] + value[i]) mod ``modulo`` along each key: a row-delta code undone without walking it."""
    out = running(df, key, order, {name: F.pmod(F.col(value).cast("long"), F.lit(modulo))})
    return out.withColumn(name, F.pmod(name, F.lit(modulo)))
