import random

import corpus_pipeline as P
import public_tokenizers
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=80):
    r = random.Random(seed)
    return " ".join(r.choice("the of and in that with from this have which were their there about would".split()) + r.choice("abcdefgh") for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_language_judges_each_row(spark):
    rows = [(i, prose(i)) for i in range(30)] + [(5, "12 34"), (None, prose(90)), (None, "56 78")]
    want = [r for r in rows if r[1] not in ("12 34", "56 78")]
    assert pairs(P.language(spark, frame(spark, rows), "")) == sorted(want, key=str)


def test_one_of_each_group_of_copies_stays(spark):
    a, b, c, d = (prose(k) for k in (1, 2, 3, 4))
    rows = [(1, a), (1, a), (2, b), (3, a), (3, c), (None, a), (None, d), (None, d), (7, d + " more"), (None, None), (2, "")]
    want = [(1, a), (2, b), (3, c), (7, d + " more"), (None, None), (2, "")]
    assert pairs(P.near_copies(spark, frame(spark, rows), "")) == sorted(want, key=str)


def test_passages_are_cut_by_row(spark):
    shared, x, y, z = prose(11, 40), prose(12, 40), prose(13, 40), prose(14, 40)
    rows = [(1, x + " # " + shared), (2, shared + " @ " + y), (2, z), (None, z), (None, shared), (4, None)]
    got = P.repeated_passages(spark, frame(spark, rows), "").collect()
    kept = {(r.doc_id, r.text) for r in got}
    assert len(got) == len(rows) and (2, z) in kept and (1, x + " # " + shared) in kept and (4, None) in kept
    assert all(len(t) < 100 for d, t in kept if d is None)
    assert all(shared not in t and t.endswith(y) for d, t in kept if d == 2 and t != z)


def test_secrets_and_packing_keep_every_row(spark):
    rows = [(1, "the token = 'aB3xQ9kLm2Zr7TpW4vYc'"), (1, prose(5)), (None, prose(6)), (None, prose(6))]
    out = pairs(P.secrets(spark, frame(spark, rows), ""))
    assert out == sorted([(1, "the token = '[SECRET]'"), *rows[1:]], key=str)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r.length for r in P.packing(spark, frame(spark, rows), "").collect()) == n
