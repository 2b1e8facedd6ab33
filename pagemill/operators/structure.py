"""Header and footer detection over the pages of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import lines, normalise_line
from pagemill.operators.joins import LEAST, SHARE, lookup
from pagemill.plans.session import cut

DEPTH, PART, LEAST_PAGES = 3, 0.6, 3


def majority(rows: DataFrame, key: list[str], value: str, name: str = "most") -> DataFrame:
    """(key) -> the one value (64-bit integer) that more than half of a key's rows may hold.

    A vote by bits: how many values have a bit set is a sum, and where one value has more than half of the
    rows, it has the greater part of every bit. So a partial result is 33 numbers, whatever the
    number of different values. Without such a value the answer is any number: count it to know.
    """
    halves = [F.sum(F.shiftright(value, k).bitwiseAND(1) + F.shiftleft(F.shiftright(value, k + 32).bitwiseAND(1), 32)).alias(f"_b{k}") for k in range(32)]
    sums = rows.groupBy(*key).agg(F.count("*").alias("_n"), *halves)  # two counts of up to 2^31 in each sum
    low, high = (lambda k: F.col(f"_b{k}").bitwiseAND((1 << 32) - 1)), (lambda k: F.shiftright(f"_b{k}", 32))
    out: Column = F.lit(0).cast("long")
    for k in range(64):
        bit = (1 << k) - (1 << 64 if k == 63 else 0)
        out = out.bitwiseOR(F.when(2 * (low(k) if k < 32 else high(k - 32)) > F.col("_n"), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(*key, out.alias(name))


def structured_text(pages: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, page, text) -> doc_id, page, header, body, footer.

    A line position, from the top or the bottom, is part of the header or footer if
    one normalised line stands there on at least 60 % of the pages, and so do
    the positions before it, three at most. All pages of the document are then
    split by position. With fewer than three pages all text is body.

    60 % is more than half, so a position has one candidate, found by a vote in constant memory; it
    is then counted, from the bottom once for each header height that it could meet. What is voted on and
    counted are 64-bit hashes of lines, written once without the texts. Partial results are a
    row a document, or position of one; what comes back to the pages is one row a document.
    """
    keep = ["doc_id", "page", "text", *extra]
    p = pages.select(*keep, lines(F.col("text")).alias("l")).withColumn("n", F.size("l"))
    hashed = lambda line: F.when(line != "", F.xxhash64(line))
    at = [("top", k, F.lit(k)) for k in range(DEPTH)] + [("end", k, F.col("n") - 1 - k) for k in range(DEPTH)]
    slim = cut(p.select("doc_id", "n", *[hashed(normalise_line(F.get("l", i))).alias(f"{side}{k}") for side, k, i in at]))
    spots = F.array(*[F.struct(F.lit(f"{side}{k}").alias("spot"), F.col(f"{side}{k}").alias("h")) for side, k, _ in at])
    votes = majority(slim.select("doc_id", F.inline(F.filter(spots, lambda x: x["h"].isNotNull()))), ["doc_id", "spot"], "h")
    names = [f"{side}{k}" for side, k, _ in at]
    best = cut(votes.groupBy("doc_id").agg(*[F.max(F.when(F.col("spot") == s, F.col("most"))).alias(f"best_{s}") for s in names]))
    full = lookup(slim, best, ["doc_id"], null_safe=True)
    hit = lambda s: F.col(s) == F.col(f"best_{s}")
    doc = full.groupBy("doc_id").agg(
        F.count("*").alias("np"),
        *[F.count_if(hit(f"top{k}")).alias(f"t{k}") for k in range(DEPTH)],
        *[F.count_if(hit(f"end{k}") & (F.col("n") - 1 - k >= h)).alias(f"e{k}{h}") for k in range(DEPTH) for h in range(DEPTH + 1)],
    )
    need = F.ceil(F.col("np") * F.lit(PART))
    prefix = lambda names: F.when(F.col(names[0]) < need, 0).when(F.col(names[1]) < need, 1).when(F.col(names[2]) < need, 2).otherwise(3)
    doc = doc.select("doc_id", "np", prefix(["t0", "t1", "t2"]).alias("h"), *[prefix([f"e{k}{h}" for k in range(DEPTH)]).alias(f"f{h}") for h in range(DEPTH + 1)])
    doc = cut(doc.select("doc_id", "np", "h", F.element_at(F.array(*[f"f{h}" for h in range(DEPTH + 1)]), F.col("h") + 1).alias("f")))
    heavy = doc.where(F.col("np") > max(LEAST, slim.count() // SHARE)).select("doc_id")
    j = lookup(p, doc, ["doc_id"], heavy=heavy, number=F.xxhash64("page"), null_safe=True, how="inner")
    top = F.least("h", "n")
    start = F.when(F.col("f") > 0, F.greatest(F.col("n") - F.col("f"), F.lit(0), top)).otherwise(F.col("n"))
    short = F.col("np") < LEAST_PAGES
    join = lambda a, size: F.array_join(F.slice("l", a, size), "\n")
    return j.select(
        "doc_id", "page",
        F.when(short, "").otherwise(join(F.lit(1), top)).alias("header"),
        F.when(short, F.col("text")).otherwise(join(top + 1, start - top)).alias("body"),
        F.when(short, "").otherwise(join(start + 1, F.col("n") - start)).alias("footer"),
        *extra,
    )
