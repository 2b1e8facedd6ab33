import random
import re

import numpy as np
import pytest

from pagemill.llm import license_scan as L

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(text):
    w, out = words(text), []
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), len(out), min((i for i, _ in out), default=None), max((i for i, _ in out), default=None), ",".join(sorted({n for _, n in out}))


def got(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in L.scan(df).collect()}


def plain_statistics(tok, templates):
    out = []
    for i in range(len(tok)):
        n = 0
        while n <= i and any(tok[i - n : i + 1] == t[k : k + n + 1] for t in templates for k in range(len(t) - n)):
            n += 1
        out.append(n)
    return out


@pytest.mark.parametrize("stretch", [4096, 5])
def test_matching_statistics_equal_a_plain_search(monkeypatch, stretch):
    monkeypatch.setattr(L, "STRETCH", stretch)
    rng = random.Random(3)
    for _ in range(15):
        texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(2, 14))) for _ in range(4)]
        a = L.Automaton(texts)
        said = [rng.choice("abcde") if rng.random() < 0.5 else w for _ in range(8) for w in rng.choice(texts).split()]
        data = np.frombuffer(" ".join(said).encode(), np.uint8)
        tok = a.tokens(data, *L.words_of(data))
        place, length, state = a.statistics(tok, np.zeros(len(tok), np.int32))
        want = plain_statistics(said, [t.split() for t in texts])
        assert dict(zip(place.tolist(), length.tolist())) == {i: n for i, n in enumerate(want) if n > 1}
        for i, n, s in zip(place.tolist(), length.tolist(), state.tolist()):
            ends = [(k, e) for k, t in enumerate(texts) for e in range(n, len(t.split()) + 1) if t.split()[e - n : e] == said[i - n + 1 : i + 1]]
            assert a.places[s] == ends


def test_base_columns_of_all_documents_equal_a_plain_search(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = L.scan(docs).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(text[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        for line, label in (("Released under the MIT License.", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"), ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("GNU General Public License, version 3.", "gpl-3.0")):
            assert (label in r.labels.split(",")) == (line in (text[r.doc_id] or ""))


def test_phrases_that_overlap_break_and_repeat(spark):
    texts = ["cc by cc by", "CC-BY", "cc  by\x00by", "ccby cc bye", "All rights reserved all rights\nreserved", "the general public license", "general public general public license", None, "", "é cc by", "cc", "gnu lesser general public license", "İcc by", "a" * 40 + " cc by"]
    out = got(spark, texts)
    for i, t in enumerate(texts):
        assert (out[i].n_words, out[i].n_base, out[i].first_word, out[i].last_word, out[i].base_labels) == plain_base(t), t
    assert out[7].score == 0 and out[7].labels == "" and out[0].score == 0.5


def test_each_template_is_found_whole_and_with_words_put_in(spark):
    texts = []
    for _, text in L.TEMPLATES:
        w = text.split()
        broken = " ".join(w[: len(w) // 2] + ["Zzyx", "qqq"] + w[len(w) // 2 :]) if len(w) > 20 else text
        texts += [f"Some prose of the day. {text} More of it.", f"x y {broken} z", " ".join(w[: len(w) // 3])]
    by = got(spark, texts)
    for i, (label, text) in enumerate(L.TEMPLATES):
        n = len(words(text))
        assert label in by[3 * i].labels.split(",") and label in by[3 * i + 1].labels.split(",")
        assert (label, n) in [(s.label, s.length) for s in by[3 * i].spans] and by[3 * i].score == 1.0
        assert label not in by[3 * i + 2].labels.split(",")


def test_a_very_long_text_is_streamed_in_pieces(spark):
    unit = "Permission of the day, all rights reserved; licensed under CC BY-NC 4.0 and so on. "
    text = unit * 120_000  # 10 MB
    (r,) = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    n = len(words(unit))
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n * 120_000, 240_000, 4, n * 119_999 + 9)
    assert len(r.spans) == 120_000 and r.labels == "cc-by,cc-by-nc-4.0,reserved"


def test_null_and_repeated_ids_extra_columns_and_an_empty_table(spark):
    schema = "doc_id long, text string, labels int, score int, spans int, n_words int"
    assert L.scan(spark.createDataFrame([], schema)).collect() == []
    rows = L.scan(spark.createDataFrame([(None, "cc by", 1, 1, 1, 1), (1, None, 1, 1, 1, 1), (1, "cc by", 1, 1, 1, 1)], schema)).collect()
    assert sorted((r.doc_id or 0, r.n_base) for r in rows) == [(0, 1), (1, 0), (1, 1)]


def test_chains_keep_to_the_order_of_the_template():
    assert L.chains([(0, 5, [5]), (7, 5, [12])], 12) == [(0, 12, 10)]
    assert sorted(L.chains([(0, 5, [12]), (7, 5, [5])], 12)) == [(0, 5, 5), (7, 5, 5)]
    assert L.chains([(0, 5, [5]), (3, 5, [8])], 12) == [(0, 8, 8)]
    assert sorted(L.chains([(0, 5, [5]), (50, 5, [10])], 12)) == [(0, 5, 5), (50, 5, 5)]
