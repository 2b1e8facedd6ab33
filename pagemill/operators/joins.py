"""A key lookup that stays balanced where one key is in a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.plans.session import cut

#: A key is heavy if more than one in SHARE rows, and more than LEAST, hold it: at most SHARE keys are.
SHARE, LEAST, SPREAD = 1000, 4096, 64


def heavy_keys(rows: DataFrame, on: list[str], share: int = SHARE, least: int = LEAST) -> DataFrame:
    """Keys that more than one in ``share`` rows (and more than ``least``) hold: at most ``share`` of them, written."""
    counts = rows.groupBy(*on).agg(F.count("*").alias("_n"))
    total = rows.count()
    return cut(counts.where(F.col("_n") > max(least, total // share)).drop("_n"))


def _meet(a: DataFrame, b: DataFrame, on: list[str], null_safe: bool, how: str) -> DataFrame:
    """Join by equal columns; the right side's keys are not kept."""
    if not null_safe:
        return a.join(b, on, how)
    other = b.withColumnsRenamed({c: f"_right_{c}" for c in on})
    return a.join(other, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on], how).drop(*[f"_right_{c}" for c in on])


def lookup(
    rows: DataFrame, table: DataFrame, on: list[str], heavy: DataFrame | None = None, number: Column | None = None,
    null_safe: bool = False, how: str = "left", spread: int = SPREAD, share: int = SHARE, least: int = LEAST,
) -> DataFrame:
    """Join of ``rows`` to ``table``, which has one row per key; a null key finds nothing unless ``null_safe``.

    Heavy keys, at most ``share``, are broadcast to mark the rows; such a key's row in the table is repeated
    ``spread`` times and its rows are dealt over the copies by ``number``, a value that a row keeps when its task runs again
    (where it is not given, ``rows`` must be a scan or written table). All other keys hold one in ``share`` rows at most.
    """
    if heavy is None:
        heavy = heavy_keys(rows if null_safe else rows.where(" and ".join(f"`{c}` is not null" for c in on)), on, share, least)
    heavy = F.broadcast(heavy.withColumn("_many", F.lit(True)))
    number = F.monotonically_increasing_id() if number is None else number
    left = _meet(rows, heavy, on, null_safe, "left").withColumn("_copy", F.when(F.col("_many"), F.pmod(number, F.lit(spread))).otherwise(0).cast("long")).drop("_many")
    copies = F.when(F.col("_many"), F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    right = _meet(table, heavy, on, null_safe, "left").withColumn("_copy", F.explode(copies)).drop("_many")
    return _meet(left, right, [*on, "_copy"], null_safe, how).drop("_copy")
