import hashlib
import random
import zlib

import pytest

from pagemill.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", sha(role or "", text or ""), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        full[c] = tuple(own.get(base, [])[:h] + v[h:])
    members, ends = {}, {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
        ends.setdefault(v, []).append(c)
    kids = {}
    for k in members:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids.get(k, 0), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()) for k, m in members.items())


def got(df, **how):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in P.trie(df, **how).collect())


def some(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(-12, n):
        for t in range(rng.randrange(1, 14)):
            rows.append((c * 3 if c % 7 == 0 else c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None, ""]), rng.choice(["hi", "é" * 5, "", None, "x"]) if t else "hello"))
    return rows + rows[:30] + [(None, 1, "user", "nobody"), (5, None, None, None), (5, 3, "user", "a"), (5, 3, "user", "b")]


@pytest.mark.parametrize("segment", [256, 3])
def test_equals_a_plain_trie(spark, tmp_path, segment):
    rows = some(60, segment)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "t"))
    assert got(spark.read.parquet(str(tmp_path / "t")), segment=segment) == plain(rows)


def test_lists_of_many_members_are_hashed_in_pieces(spark):
    rows = [(c, 0, "user", "same") for c in range(0, 500)]
    ids = spark.createDataFrame([(b"a", c) for c in range(-5, 2_000)] + [(b"b", 3)], "digest binary, conv_id long")
    out = {r.digest: r.ends for r in P.list_hashes(ids, piece=64).collect()}
    assert out[b"a"] == hashlib.sha256(",".join(map(str, range(-5, 2_000))).encode()).hexdigest() and out[b"b"] == hashlib.sha256(b"3").hexdigest()
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_one_conversation_of_half_of_all_rows_and_clashing_columns(spark, tmp_path):
    rows = [(10, t, "user", f"{t % 3}") for t in range(400)] + [(11, t, "user", f"{t % 3}") for t in range(20)] + [(c, 0, "user", "x") for c in range(100, 400)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as pos", "2 as n", "3 as digest", "4 as depth", "5 as size", "6 as _id")
    df.write.parquet(str(tmp_path / "t"))
    assert got(spark.read.parquet(str(tmp_path / "t")), segment=32) == plain(rows)


def test_an_empty_table_and_rows_without_conversation(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)) == []
