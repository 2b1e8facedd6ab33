import random

from pyspark.sql import functions as F

from pagemill.operators import joins
from pagemill.operators.references import dereference, settled
from pagemill.operators.trees import enumerate_nodes

NODE = "doc_id string, id long, parent long, place long"


def plain(rows, leaves_only=True):
    kids, ids = {}, {(d, i) for d, i, *_ in rows}
    for d, i, p, k in rows:
        kids.setdefault((d, p), []).append((k, i))
    out = {}
    for d in {r[0] for r in rows}:
        stack, n = sorted(kids.get((d, None), []), reverse=True), 0
        while stack:
            _, i = stack.pop()
            below = sorted(kids.get((d, i), []), reverse=True)
            if not (below and leaves_only):
                n += 1
                out[d, i] = n
            stack += below
    return out


def written(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_leaves_of_random_trees_and_what_is_cut_off(spark, tmp_path):
    rng = random.Random(8)
    rows = [(d, i, None if i == 0 else rng.randrange(max(0, i - 12), i), rng.randrange(3)) for d in "abc" for i in range(400)]
    rows += [("flat", i, None if i == 0 else 0, -i) for i in range(3_000)] + [("forest", i, None, 5 - i) for i in range(4)]
    rows += [("lost", 0, None, 0), ("lost", 1, 77, 0), ("lost", 2, 3, 0), ("lost", 3, 2, 0), ("lost", 4, 1, 0), ("lost", 5, 3, 0), ("alone", 1, None, None)]
    df = written(spark, rows, NODE, tmp_path / "t")
    for only in (True, False):
        got = {(r.doc_id, r.id): r.page for r in enumerate_nodes(df, only).collect()}
        assert got == plain(rows, only)


def test_a_chain_of_ten_thousand_nodes(spark, tmp_path):
    rows = [("d", i, i - 1 if i else None, 0) for i in range(10_000)] + [("d", 10_000, 0, 1)]
    got = {r.id: r.page for r in enumerate_nodes(written(spark, rows, NODE, tmp_path / "t")).collect()}
    assert got == {9_999: 1, 10_000: 2}


def test_an_empty_tree(spark):
    assert enumerate_nodes(spark.createDataFrame([], NODE)).collect() == []


def objects(spark, rows, path):
    return written(spark, rows, "doc_id string, id string, json string", path).select("doc_id", "id", F.parse_json("json").alias("value"))


def test_references_of_any_length(spark, tmp_path):
    rows = [("d", f"r{i}", '{"ref": "r%d"}' % (i + 1)) for i in range(3_000)] + [("d", "r3000", '{"name": "end"}')]
    rows += [("d", "a", '{"ref": "b"}'), ("d", "b", '{"ref": "a"}'), ("d", "in", '{"ref": "a"}'), ("d", "gone", '{"ref": "nowhere"}'), ("d", "self", '{"ref": "self"}'), ("e", "r0", "7"), ("d", "none", None)]
    obs = objects(spark, rows, tmp_path / "o")
    ends = {(r.doc_id, r.id): (r.target, r.hops) for r in settled(obs).collect()}
    assert all(ends["d", f"r{i}"] == ("r3000", 3_000 - i) for i in range(3_001))
    assert not any(k in ends for k in (("d", "a"), ("d", "b"), ("d", "in"), ("d", "gone"), ("d", "self")))
    refs = written(spark, [(d, i, n) for n, (d, i) in enumerate([("d", "r0"), ("e", "r0"), ("d", "a"), ("d", "unknown"), ("d", None), (None, "r0"), ("d", "none")] + [("d", "r5")] * 6_000)], "doc_id string, id string, n long", tmp_path / "r")
    got = {r.n: (r.hops, r.v) for r in dereference(refs, obs).select("n", "hops", F.to_json("value").alias("v")).collect()}
    assert got[0] == (3_000, '{"name":"end"}') and got[1] == (0, "7") and got[6] == (0, None)
    assert all(got[i] == (None, None) for i in (2, 3, 4, 5))
    assert all(got[i] == (2_995, '{"name":"end"}') for i in range(7, 6_007)) and len(got) == 6_007


def test_a_lookup_deals_a_heavy_key(spark, tmp_path):
    rows = written(spark, [(1 if i % 3 else i, i) for i in range(30_000)] + [(None, -1)], "k long, v long", tmp_path / "a")
    table = written(spark, [(i, i * 2) for i in range(0, 30_000, 3)] + [(1, 5)], "k long, w long", tmp_path / "b")
    out = joins.lookup(rows, table, ["k"], spread=16)
    got = sorted((r.v, r.w) for r in out.collect())
    want = sorted((v, None if k is None else 5 if k == 1 else k * 2) for k, v in [(1 if i % 3 else i, i) for i in range(30_000)] + [(None, -1)])
    assert got == want and joins.heavy_keys(rows, ["k"]).count() == 1
