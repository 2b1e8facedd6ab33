import random

from pyspark.sql import functions as F

from pagemill.operators import ranges as R
from pagemill.sources.sorted_sink import read_sorted, write_sorted


def runs(pages):
    out = []
    for p in sorted(pages):
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [tuple(x) for x in out]


def by_key(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.k, []).append((r["first"], r["last"]))
    return {k: sorted(v) for k, v in out.items()}


def test_ranges_of_pages_and_their_union_and_rest(spark):
    rng = random.Random(5)
    pages = {k: [rng.randrange(1, 120) for _ in range(rng.randrange(1, 90))] for k in ["a", "b", None, "d"]}
    df = spark.createDataFrame([(k, p) for k, v in pages.items() for p in v] + [("a", None)], "k string, page long")
    assert by_key(R.page_ranges(df, ["k"])) == {k: runs(set(v)) for k, v in pages.items()}
    many = [(k, a, a + rng.randrange(25)) for k in ["a", "b", None] for a in (rng.randrange(1, 100) for _ in range(12))]
    rdf = spark.createDataFrame(many, "k string, first long, last long")
    held = {k: [p for kk, a, b in many if kk == k for p in range(a, b + 1)] for k in ["a", "b", None]}
    assert by_key(R.union_ranges(rdf, ["k"])) == {k: runs(set(v)) for k, v in held.items()}
    twice = {k: {p for p in v if v.count(p) > 1} for k, v in held.items()}
    assert by_key(R.union_ranges(rdf, ["k"], depth=2)) == {k: runs(v) for k, v in twice.items() if v}
    whole = spark.createDataFrame([(k, 10, 90) for k in ["a", "b", None, "none"]], "k string, first long, last long")
    want = {k: runs(set(range(10, 91)) - set(held.get(k, []))) for k in ["a", "b", None, "none"]}
    assert by_key(R.except_ranges(whole, rdf, ["k"])) == {k: v for k, v in want.items() if v}


def test_a_document_of_a_million_pages(spark):
    pages = spark.range(1, 1_000_001).select(F.lit("d").alias("k"), F.col("id").alias("page")).where("page % 250000 <> 7")
    ranges = R.page_ranges(pages, ["k"])
    assert by_key(ranges)["d"] == [(1, 6), (8, 250_006), (250_008, 500_006), (500_008, 750_006), (750_008, 1_000_000)]
    assert R.pages_of(ranges).agg(F.count_distinct("page"), F.max("page")).first()[:] == (999_996, 1_000_000)
    maps = R.page_bitmaps(pages, ["k"])
    assert maps.count() == 31 and R.pages_counted(maps, ["k"]).first().n_pages == 999_996
    other = R.page_bitmaps(spark.createDataFrame([("d", 7), ("d", 7), ("d", 8), ("d", None)], "k string, page long"), ["k"])
    assert R.pages_counted(R.merged_bitmaps(maps.union(other), ["k"]), ["k"]).first().n_pages == 999_997


def test_no_ranges_and_no_pages(spark):
    none = spark.createDataFrame([], "k string, page long")
    assert R.page_ranges(none, ["k"]).collect() == [] and R.page_bitmaps(none, ["k"]).collect() == []
    assert R.union_ranges(spark.createDataFrame([], "k string, first long, last long"), ["k"]).collect() == []


def test_files_of_a_sorted_sink_ascend_and_cover_all_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [("hot" if i % 2 else rng.choice([None, "a", "b", "z"]), rng.randrange(5) if i % 2 else None, i) for i in range(8_000)]
    df = spark.createDataFrame(rows, "k string, page long, annotation_index long").repartition(5)
    by = ["k", "page", "annotation_index"]
    m = write_sorted(df, str(tmp_path / "s"), by).orderBy("number").collect()
    key = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
    assert sum(r.n_rows for r in m) == 8_000 and len(m) > 4 and max(r.n_rows for r in m) < 2 * sorted(r.n_rows for r in m)[len(m) // 2]
    assert all(key(r.first_key) <= key(r.last_key) for r in m) and all(key(a.last_key) < key(b.first_key) for a, b in zip(m, m[1:]))
    got = [tuple(r)[:3] for r in read_sorted(spark, str(tmp_path / "s")).orderBy("place").collect()]
    assert got == sorted(rows, key=key)
    assert [r.before for r in m] == [sum(x.n_rows for x in m[:i]) for i in range(len(m))]


def test_a_key_of_all_rows_spreads_and_an_empty_frame(spark, tmp_path):
    df = spark.createDataFrame([("k", i) for i in range(4_000)], "k string, v long")
    m = write_sorted(df, str(tmp_path / "s"), ["k"])
    assert m.count() > 4 and read_sorted(spark, str(tmp_path / "s")).agg(F.count_distinct("place"), F.max("place")).first()[:] == (4_000, 3_999)
    write_sorted(df.limit(0), str(tmp_path / "e"), ["k"])
    assert read_sorted(spark, str(tmp_path / "e")).collect() == []
