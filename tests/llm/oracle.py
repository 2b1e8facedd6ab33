import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    import math

    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    return v


def same(spark_df, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want = sorted(repr(sorted((n, plain(v)) for n, v in zip(names, r))) for r in cur.fetchall())
    got = sorted(repr(sorted((n, plain(v)) for n, v in r.asDict(True).items())) for r in spark_df.collect())
    assert sorted(names) == sorted(spark_df.columns)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b
