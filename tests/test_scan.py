import random

from pyspark.sql import functions as F

from pagemill.operators import scan as S


def plain(rows):
    seen, out = {}, []
    for k, o, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0)):
        n, s = seen.get(k, (0, 0))
        seen[k] = (n + 1, s + (v or 0))
        out.append((k, o, v, n, s + (v or 0)))
    return out, {k: n for k, (n, _) in seen.items()}


def table(spark, rows, tmp_path):
    spark.createDataFrame(rows, "k string, o long, v long").write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


def test_a_key_of_half_of_all_rows_spans_ranges(spark, tmp_path):
    rng = random.Random(4)
    rows = [("hot" if i % 2 else f"k{rng.randrange(300)}", i, rng.randrange(-50, 300)) for i in range(20_000)]
    rows += [(None, 1, 5), (None, None, 7), ("null value", 1, None)]
    want, size = plain(rows)
    df = table(spark, rows, tmp_path)
    got = S.running(df, ["k"], ["o"], {"n": F.lit(1), "s": F.col("v")}, {"all": F.lit(1)}).collect()
    assert sorted((r.k or "", r.o or -1, r.n - 1, r.s, r["all"]) for r in got) == sorted((k or "", o or -1, n, s, size[k]) for k, o, _, n, s in want)
    rng_parts = S.laid_out(df, ["k"], ["o"]).groupBy("_part").count().collect()
    sizes = sorted(r["count"] for r in rng_parts)
    assert len(sizes) == 8 and sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_copies_of_one_row_are_numbered_too(spark, tmp_path):
    df = table(spark, [("a", 1, 3)] * 5_000, tmp_path)
    got = sorted(r.pos for r in S.numbered(df, ["k"], ["o"], total="n").where("n = 5000").collect())
    assert got == list(range(5_000))
    assert S.laid_out(df, ["k"], ["o"]).select("_part").distinct().count() > 4


def test_an_empty_table_and_a_negative_delta(spark, tmp_path):
    df = table(spark, [], tmp_path)
    assert S.numbered(df, ["k"], ["o"]).collect() == []
    rows = [("a", i, v) for i, v in enumerate([250, 10, -20, 256])]
    (tmp_path / "u").mkdir()
    got = [r.decoded for r in S.recurrence(table(spark, rows, tmp_path / "u"), ["k"], ["o"], "v").orderBy("o").collect()]
    assert got == [250, 4, 240, 240]
