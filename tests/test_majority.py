import random
from collections import Counter

from pagemill.operators.structure import majority, structured_text


def test_the_value_of_more_than_half_wins_the_vote(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for k in range(60):
        n = rng.randrange(1, 80)
        top = rng.choice([-(2**63), 2**63 - 1, 0, -1, rng.randrange(-(2**63), 2**63)])
        vals = [top] * (n // 2 + 1) + [rng.randrange(-(2**63), 2**63) for _ in range(n - n // 2 - 1)]
        rng.shuffle(vals)
        rows += [(k, v) for v in vals]
        want[k] = Counter(vals).most_common(1)[0][0]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    assert {r.k: r.most for r in majority(df, ["k"], "v").collect()} == want


def test_one_document_of_nearly_all_pages_and_one_without_id(spark):
    rows = [("big", i, f"Head {i}\nline {i * 7919 % 6007} of\nFoot") for i in range(6_000)]
    rows += [(None, i, f"A\nb{'x' * i}\nC{i}") for i in range(4)] + [("two", i, "H\nt") for i in range(2)] + [("split", i, f"{'ab'[i % 2]}\nq") for i in range(10)]
    got = {(r.doc_id, r.page): (r.header, r.body, r.footer) for r in structured_text(spark.createDataFrame(rows, "doc_id string, page long, text string")).collect()}
    assert len(got) == len(rows)
    assert all(got["big", i] == (f"Head {i}\nline {i * 7919 % 6007} of\nFoot", "", "") for i in range(0, 6_000, 500))
    assert all(got[None, i] == ("A", "b" + "x" * i, f"C{i}") for i in range(4))
    assert got["two", 0] == ("", "H\nt", "") and got["split", 3] == ("", "b", "q")
