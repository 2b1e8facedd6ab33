"""Very long texts, ties, repeated rows and rows without a key, operator by operator."""

import random
import zlib

import numpy as np
import public_tokenizers
from pagemill.llm.gam import score
from pagemill.llm.packing import pack, range_table
from pagemill.llm.quality_rules import apply_rules
from pagemill.llm.suffix_dedup import dedup
from pagemill.llm.warc import read_archives, write_archives
from tokenizers import Tokenizer

from tests.llm import test_quality_rules as rules
from tests.llm import test_suffix_dedup as passages
from tests.llm import test_warc as warc

PATH = public_tokenizers.path("byte_bpe_50k.json")


def prose(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    return " ".join(r.choice(words) for _ in range(n))


def test_rules_of_a_long_text(spark):
    long = "\n".join(prose(k, 12) for k in range(4000)) + "\nfoot 1"
    rows = [(1, long, "s"), (2, "a b c d e f g h i j\nfoot 2", "s"), (3, "foot 3", "s")]
    got = apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), most_docs=2, least_left=60).collect()
    want = rules.brute([(d, t, s) for d, t, s in rows if d > 1], 1, 60)
    by = {x.doc_id: tuple(x)[1:] for x in got}
    assert by[1][0] == len(long.split()) and by[1][5:] == (False, True)
    assert {d: by[d] for d in want} == want


def test_rules_of_repeated_and_unkeyed_rows(spark):
    line = "one two three four five six seven eight nine ten"
    rows = [(4, line, "s"), (4, line, "s"), (2, line, "s"), (None, line, "s")]
    got = apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), most_docs=3).collect()
    assert sorted((str(x.doc_id), x.kept) for x in got) == [("2", True), ("4", False), ("4", False), ("None", True)]


def test_payload_larger_than_a_frame(spark, tmp_path):
    rows = [(1, "a", prose(1, 90_000)), (2, "b", "x"), (3, "c", prose(1, 90_000)), (4, "d", prose(2, 500))]
    index = write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w", frame_bytes=1000)
    got = read_archives(index, f"file://{tmp_path}/w").collect()
    assert {r.page_id: tuple(r)[1:5] for r in got} == warc.want(rows)
    assert {r.page_id: r.payload.decode() for r in got if r.record_type == "response"} == {p: h for p, _, h in rows if p != 3}


def test_packing_of_long_repeated_and_unkeyed_rows(spark):
    long = prose(3, 250_000)
    rows = [(1, long), (2, "a b"), (2, "a b"), (None, "c"), (None, None)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    tok = Tokenizer.from_file(PATH)
    ids = {d: [*tok.encode(t, add_special_tokens=False).ids, 1] for d, t in ((1, long), (2, "a b"))}
    at = 0
    for p in sorted((p for p in got if p.doc_id == 1), key=lambda p: p.start):
        assert p.start == at and p.doc_tokens == len(ids[1])
        at += p.length
        assert p.ids_crc32 == zlib.crc32(np.array(ids[1][p.start : at], "<u4").tobytes())
    assert at == len(ids[1])
    assert sum(p.length for p in got if p.doc_id == 2) == 2 * len(ids[2])
    assert sum(p.length for p in got if p.doc_id is None) == len(tok.encode("c").ids) + 2
    by = {}
    for p in got:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for pieces in by.values():
        end = 0
        for o, n in sorted(pieces):
            assert o == end
            end += n
        assert end <= 2048


def test_ranges_follow_weight():
    r = random.Random(1)
    weights = [(c, r.choice([1, 50, 3000])) for c in range(200)]
    deal = range_table(weights, 1000)
    last = 0
    for _, first, many in deal:
        assert first in (last, last + 1) or first == last
        last = first + many - 1
    assert last + 1 == -(-sum(s for _, s in weights) // 1000)


def test_scores_of_ties_and_long_texts(spark):
    long = prose(5, 400_000)
    docs = spark.createDataFrame([(1, long), (2, "same text here"), (3, "same text here"), (3, "same text here"), (4, "### " * 20)] + [(10 + k, prose(k, 30 + k)) for k in range(40)] + [(60 + k, "### " * (k + 2)) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(10 + k, 1) for k in range(40)] + [(60 + k, 0) for k in range(40)], "doc_id long, quality int")
    got = score(docs, labels).collect()
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x.score)
    assert len(got) == docs.count() and len({*by[2], *by[3]}) == 1 and len(by[3]) == 2
    assert all(0 <= s <= 1 for v in by.values() for s in v) and by[1][0] > 0.5 > by[4][0]


def test_passages_of_texts_beyond_a_block(spark):
    """Texts of more than the block that is ordered together, with passages of each other and of themselves."""
    base = prose(7, 60_000)
    rows = [(5, base + " " + base[1000:5000]), (3, base[:400_000][::-1] + base[200_000:200_300]), (9, base[200_100:200_250]), (8, prose(8, 230_000) + base[:150])]
    got = dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    want = passages.brute(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert want[9][1] == 150 and want[5][1] > 4000
