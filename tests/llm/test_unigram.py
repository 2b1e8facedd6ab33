import random
import struct
import time

import numpy as np
import public_tokenizers as P
import sentencepiece as spm
from pagemill.llm.sentencepiece import Pieces, pieces

NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def unigram_file(path, table):
    """A model file of the public format, put together by hand: (piece, score, kind) rows, unigram search, byte fallback."""
    rows = [("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL), ("</s>", 0.0, CONTROL), *((f"<0x{b:02X}>", 0.0, BYTE) for b in range(256)), *table]
    body = b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, k)) for p, s, k in rows)
    trainer = field(3, 1) + field(4, len(rows)) + field(35, 1)
    normal = field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1)
    path.write_bytes(body + field(2, trainer) + field(3, normal))
    return str(path)


def same(path, texts):
    ours, library = Pieces(path), spm.SentencePieceProcessor(model_file=path)
    return [x.tolist() == library.encode(t) for t, x in zip(texts, ours.encode(texts))]


def test_ids_of_the_library(tmp_path):
    """Unigram models of random pieces and scores, also pieces that reach over blanks: the library's own ids.

    Scores are 64ths, so that the library's sums in single precision are exact: else rounding decides
    between paths of equal total (the same pieces in another order).
    """
    for seed in range(6):
        r = random.Random(seed)
        alphabet = r.choice(["ab", "abc▁", "abcdeé▁", "日本語ab▁"])
        made = {"".join(r.choice(alphabet) for _ in range(r.randint(1, 7))) for _ in range(120)} | set(alphabet[:-1])
        path = unigram_file(tmp_path / f"{seed}.model", [(p, -r.randint(64, 768) / 64, NORMAL) for p in sorted(made)])
        texts = ["".join(r.choice(alphabet + "x🙂 ") for _ in range(r.randint(0, 90))).replace("▁", " ") for _ in range(300)]
        assert all(same(path, texts))


def test_ids_on_the_given_pieces(tmp_path):
    """The given file's pieces under a unigram search: the library's ids, once the -10^9 of its blank pieces is raised.

    The library works in single precision, where a step at 10^9 is 64, and chooses a worse total then
    (its own n-best search gives ours); other scores are whole numbers, of which sums are exact.
    """
    m = pieces(P.path("piece_bpe_32k.model"))
    table = [(m.text[i], max(m.score[i], -1e6), NORMAL) for i in range(259, len(m.text))]
    r = random.Random(3)
    words = ["the", "Haus", "été", "niño", "reading", "zq", "x1", "日本", "tion"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(200)]
    assert all(same(unigram_file(tmp_path / "u.model", table), texts))


def test_long_words():
    """Text without blanks: cut where it can be, else gone through in order; as a plain search finds it, and fast."""
    from tests.llm.test_sentencepiece import brute

    m = pieces(P.path("piece_bpe_32k.model"))
    r = random.Random(2)
    texts = ["".join(r.choice("etaoin") for _ in range(5000)), "=" * 3000, "日本語" * 900 + "🙂", "ab" * 2500, "x" * 65]
    for t, x in zip(texts, m.encode(texts)):
        assert x.tolist() == brute(m, t)
    start = time.time()
    for t in ("".join(r.choice("etaoinshrdlu") for _ in range(1_000_000)), "=" * 1_000_000):
        x = m.encode([t])[0]
        assert m.decode(x) == t
    assert time.time() - start < 90


def test_same_length_words_share_a_search():
    m = pieces(P.path("piece_bpe_32k.model"))
    words = ["▁the", "▁abc", "▁été", "▁the"]
    assert [x.tolist() for x in m.viterbi(words)] == [m.viterbi([w])[0].tolist() for w in words]
    assert np.array_equal(m.viterbi(["▁" + "ab" * 40])[0], m._walk(np.frombuffer(("▁" + "ab" * 40).encode("utf-32-le"), np.uint32)))


def test_a_word_of_a_megabyte_of_many_stretches():
    """Unspaced Japanese, hexadecimal, base64 and a repeated pair: linear in the word, and the ids of one search of the whole word."""
    import base64

    m = pieces(P.path("piece_bpe_32k.model"))
    r = random.Random(5)
    kana = "".join(chr(r.choice([*range(0x3041, 0x3097), *range(0x4E00, 0x4E80)])) for _ in range(340_000))
    for t in (kana, r.randbytes(500_000).hex(), base64.b64encode(r.randbytes(750_000)).decode(), "ab" * 500_000):
        start = time.time()
        x = m.viterbi([t])[0]
        assert time.time() - start < 20
        part = t[:60_000]
        assert m.viterbi([part])[0].tolist() == m._walk(np.frombuffer(part.encode("utf-32-le"), np.uint32)).tolist()
        assert m.decode(m.encode([t])[0]) == t and len(x) > 100_000
