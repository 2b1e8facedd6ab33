import hashlib
import random
import zlib

import pytest

from pagemill.llm.merkle import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes, fan=2):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def plain(rows, fan=2):
    def leaf(r, n):
        return H(field(r[0]), field(r[3]), field(r[2]), field(n), field(r[1]))

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    langs = sorted(groups, key=lambda l: (l is not None, (l or "").encode()))
    tree = {l: levels([leaf(r, r[4]) for r in groups[l]], fan) for l in langs}
    top, out = levels([tree[l][-1][0] for l in langs], fan), []
    for li, l in enumerate(langs):
        for i, r in enumerate(groups[l]):
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            acc, seen = leaf(r, r[4] + 1 if hit else r[4]), []
            for lv, j in ((tree[l], i), (top, li)):
                for nodes in lv[:-1]:
                    a = j - j % fan
                    left, right = nodes[a:j], nodes[j + 1 : a + fan]
                    seen += left + right
                    acc, j = H(*left, acc, *right), j // fan
            out.append((r[0] if r[0] is not None else -1, leaf(r, r[4]), tree[l][-1][0], top[-1][0], H(*seen), acc, acc == top[-1][0]))
    return sorted(out)


def got(df, **how):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in manifest(df, **how).collect())


ROWS = [(i, f"text {i} é" * (i % 4), "abcd"[min(3, random.Random(i).randrange(9))], f"s{i % 3}", i * 3) for i in range(150)]
ROWS += [(None, "no id", "a", None, 4), (None, None, None, None, None), (7, "other text", "a", "s", None), (9, None, "b", None, 0), (9, None, "b", None, 0), (3, "", "é", "", 1), (5, "x", "z" * 3000, "", 1), (6, "lone", "", "", -2)]


@pytest.mark.parametrize("fan,deep", [(2, 10), (2, 2), (3, 1)])
def test_equals_plain_trees(spark, tmp_path, fan, deep):
    rows = ROWS * (2 if deep < 10 else 1)
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "t"))
    assert got(spark.read.parquet(str(tmp_path / "t")), fan=fan, levels=deep) == plain(rows, fan)


def test_empty_and_single_tables_and_clashing_columns(spark):
    assert manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    one = [(14, "x" * 2_000_000, "en", "s", 2_000_000)]
    df = spark.createDataFrame(one, SCHEMA)
    for name in ("pos", "n", "node", "leaf", "root", "top", "_id", "block"):
        df = df.selectExpr("*", f"1 as {name}")
    assert got(df) == plain(one)
    assert got(df)[0][4] == hashlib.sha256(b"").hexdigest()


def test_a_changed_row_does_not_verify(spark):
    rows = [(i, "t", "en", "s", 1) for i in range(60)]
    flags = {r.doc_id: r.verified for r in manifest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(flags[i] != (zlib.crc32(str(i).encode()) % 7 == 0) for i in flags) and False in flags.values()
