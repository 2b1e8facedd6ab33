import random
import re

from pagemill.llm.quality_rules import ORACLE, apply_rules

from tests.llm.oracle import same


def brute(rows, most_docs, least_left):
    out, lines, count = {}, {}, {}
    for d, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = {x for x in wins if wins.count(x) > 1}
        rep = len({i + k for i, x in enumerate(wins) if x in twice for k in range(5)})
        ls = [x for x in t.split("\n") if x.strip(" \t\n\x0b\f\r")]
        lines[d] = {re.sub("[0-9]+", "0", x.strip(" \t\n\x0b\f\r")) for x in ls}
        for x in lines[d]:
            count.setdefault((s or "", x), []).append(d)
        failed = len(w) < 10 or 100 * rep > 20 * len(w)
        out[d] = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), rep, failed]
    for d, t, s in rows:
        size = sum(map(len, lines[d]))
        gone = sum(len(x) for x in lines[d] if len(c := count[s or "", x]) > most_docs and min(c) < d)
        out[d].append(not out[d][5] and 100 * (size - gone) >= least_left * size)
    return {d: tuple(v) for d, v in out.items()}


def test_brute_force(spark):
    r = random.Random(2)
    rows = []
    for i in range(160):
        w = [r.choice(["a", "bé", "#c", "d|", "e1", "ß<", "it", "日本"]) for _ in range(r.randint(0, 40))]
        body = "".join(x + r.choice([" ", "\n", "\t", "  ", "\r\n", "\x0b"]) for x in w)
        rows.append((i, body + ("common 12 line here\n and another one 3\n" if i % 3 == 0 else ""), r.choice(["s", "t", None])))
    rows += [(900, None, "s"), (901, "", "s"), (902, " \n ", None), (903, "x y z w v " * 30, "t"), (904, "a\n" * 9, "t")]
    got = apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), most_docs=5, least_left=60).collect()
    want = brute(rows, 5, 60)
    assert {x.doc_id: tuple(x)[1:] for x in got} == want
    assert any(not w[5] and not w[6] for w in want.values())


def test_edges(spark):
    assert apply_rules(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    row = (1, "one two three four five six seven eight nine ten", "s", "h1", 3)
    got = apply_rules(spark.createDataFrame([row, row], "doc_id long, text string, source string, host string, size int")).collect()
    assert len(got) == 2 and all(x.kept for x in got)


def test_oracle(spark, sf):
    same(apply_rules(spark.read.parquet(f"{sf}/documents.parquet")), ORACLE, sf)
