"""Secret scans: candidate strings judged by a random forest.

One pass over the corpus learns how likely each character follows another and which
words are common. Patterns find long strings, values assigned to a credential-like name (NAME=VALUE,
NAME: VALUE, quoted or not; the value is the candidate) and passwords in addresses;
the forest, trained from labelled findings, removes false positives
(card numbers, commit ids, checksums, paths, identifiers, placeholders).
"""

from __future__ import annotations

import random
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.bytesio import LOWER, prefix_hash, range_hash, slices, tidy
from pagemill.llm.spark import batch, cut, least_hashed

#: Fixed word lists: names that announce a credential, names that announce something else, parts of ordinary identifiers.
ANNOUNCE = "token secret password passwd apikey api_key key access_key auth authorization bearer credential private client_secret".split()
OTHERWISE = "commit sha sha1 sha256 md5 checksum digest hash etag uuid guid id rev revision build version isbn order invoice tracking phone card example sample placeholder test".split()
WORDS = "the and for key token secret password user name data file path image page index test example sample config session client server service account admin default value string number version build release commit branch master main http https html json image photo video upload download public private static assets content home login order item product customer address email phone date time year month day local remote cache temp backup your here change replace insert dummy fake null none true false".split()
FEATURES = ("length", "entropy", "surprise", "transitions", "digits", "upper", "lower", "hex", "repeat", "dictionary", "path", "dots", "announced", "otherwise", "assigned", "quoted", "uuid_shape", "all_digits", "marks", "brackets", "userinfo", "place")
_WORD = re.compile("|".join(sorted((w for w in WORDS if len(w) > 2), key=len, reverse=True)))
_BEFORE = re.compile(r"[A-Za-z0-9_]+")
_NAMES = "|".join(sorted(ANNOUNCE, key=len, reverse=True))
#: A word that ends in an announcing name: whole, after a mark or a change of case, or one of those no other word ends in.
_ANNOUNCES = re.compile(rf"(?:(?:^|[^A-Za-z]|(?<=[a-z])(?=[A-Z]))(?i:{_NAMES})|(?i:token|secret|password|passwd|apikey))[_\d]*$")
#: Long strings; '=' only as padding at their end, so that the value of NAME=VALUE stands alone.
LONG = re.compile(r"(?<![A-Za-z0-9+/_.\-])(?=[+/_.\-]*[A-Za-z0-9])[A-Za-z0-9+/_.\-]{14,}(?:=+(?![A-Za-z0-9+/_.\-=]))?")
_SEP = r"""["']?\s{0,3}(?:=>|:=|[=:])\s{0,3}"""
#: Values after an announcing name; unquoted ones end at the next name of a list.
ASSIGNED = re.compile(
    rf"""(?i:(?<![a-z0-9_.\-])[a-z0-9_.\-]*(?:{_NAMES})[_\-]?[0-9]*{_SEP}(?:(?:bearer|basic|token)\s{{1,3}})?)(?!(?i:[a-z0-9_.\-]*(?:{_NAMES})[_\-]?[0-9]*{_SEP}))"""
    r"""(?:(?P<q>["'])(?P<quoted>(?:(?!(?P=q))\S){6,})|(?P<bare>(?:[^\s"',;&]|[,;&](?![A-Za-z0-9_.\-]+["']?[=:])){6,}))"""
)
#: The password of scheme://user:password@host.
USERINFO = re.compile(r"""(?<=[A-Za-z0-9])://[^\s/:@"'<>]*:([^\s/"'<>]+)@(?=[A-Za-z0-9\[])""")
_CLOSERS = {")": "(", "]": "[", "}": "{", ">": "<"}
#: Parts of a path that hold made-up values.
PLACES = re.compile(r"(?i)(?:^|[^a-z])(?:test|tests|spec|example|examples|sample|samples|fixture|fixtures|mock|mocks|doc|docs|vendor)(?:[^a-z]|$)")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLASS = np.array([3] * 256)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 0, 1, 2


#: Characters as transitions see them: printable ASCII one by one, all else as one.
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[32:127] = np.arange(1, 96)
SYMBOLS = 96
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True


@dataclass(frozen=True)
class Background:
    """What the corpus says: -log P(character | the one before it), and its common words in lower case."""

    surprise: np.ndarray
    words: frozenset[str]


def background_of(pairs: dict[int, int], words: Iterable[str]) -> Background:
    n = np.full(SYMBOLS * SYMBOLS, 0.5)
    for k, v in pairs.items():
        n[k] += v
    n = n.reshape(SYMBOLS, SYMBOLS)
    return Background(-np.log(n / n.sum(1, keepdims=True)), frozenset(words))


_SEEN = pa.schema([("word", pa.string()), ("pair", pa.int32()), ("n", pa.int64())])


def _seen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of character pairs of all texts, and of their words of three ASCII letters or more.

    Pairs with a digit are left out: so keys and numbers of the texts do not make their own kind look usual.
    """
    pairs = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for _, data, off in slices(batches, most=1 << 20):
        symbol = _SYMBOL[data]
        both = symbol[:-1] * SYMBOLS + symbol[1:]
        ends = off[1:-1]
        digit = (data >= 48) & (data < 58)
        keep = ~(digit[:-1] | digit[1:])
        keep[ends[(ends > 0) & (ends <= len(both))] - 1] = False
        pairs += np.bincount(both[keep], minlength=len(pairs))
        low, edge = LOWER[data], np.zeros(len(data) + 1, bool)
        edge[ends[ends < len(data)]] = True
        letter = np.append(_LETTERS[data], False)
        before = np.append(False, letter[:-1]) & ~edge
        after = np.append(letter[1:], False) & ~np.append(edge[1:], False)
        start, end = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
        long = end - start >= 3
        start, end = start[long], end[long]
        _, first, n = np.unique(range_hash(prefix_hash(low), start, end), return_index=True, return_counts=True)
        raw = low.tobytes()
        yield batch({"word": [raw[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist())], "pair": [None] * len(first), "n": n}, _SEEN)
    at = np.flatnonzero(pairs)
    yield batch({"word": [None] * len(at), "pair": at, "n": pairs[at]}, _SEEN)


def learn(docs: DataFrame, rarest: int = 50_000) -> Background:
    """Character transitions and the dictionary, from every whole text.

    The dictionary is each word that makes up one in ``rarest`` of all words or more, so it has
    ``rarest`` words at most, whatever the corpus; transitions are SYMBOLS squared counts.
    """
    seen = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(_seen), "word string, pair int, n long")
    counts = cut(seen.groupBy("word", "pair").agg(F.sum("n").alias("n")))
    pairs = {r["pair"]: r["n"] for r in counts.where("pair is not null").select("pair", "n").collect()}
    total = counts.where("word is not null").agg(F.sum("n")).first()[0] or 0
    return background_of(pairs, [r["word"] for r in counts.where((F.col("n") * rarest >= total) & F.col("word").isNotNull()).select("word").collect()])


def describe(text: str, start: int, end: int, known: Background, place: str = "") -> list[float]:
    """FEATURES of the candidate text[start:end] with its neighbouring words; place: path or source of the text."""
    s = text[start:end]
    raw = np.frombuffer(s.encode("latin-1", "replace"), np.uint8)
    n = len(raw)
    cls = _CLASS[raw]
    share = np.bincount(raw) / n
    share = share[share > 0]
    low = s.lower()
    symbol = _SYMBOL[raw]
    covered = max(sum(m.end() - m.start() for m in _WORD.finditer(low)), sum(len(w) for w in _PART.findall(s) if len(w) > 2 and w.lower() in known.words))
    before = text[max(0, start - 40) : start]
    near = _BEFORE.findall(before)[-3:]
    announced = float(any(_ANNOUNCES.search(w) for w in near))
    otherwise = float(any(w in OTHERWISE or any(w.endswith("_" + x) for x in OTHERWISE) for w in map(str.lower, near)))
    hexes = sum(c in "0123456789abcdef" for c in low)
    return [
        float(n), float(-(share * np.log2(share)).sum()), float(known.surprise[symbol[:-1], symbol[1:]].mean()) if n > 1 else 0.0, float((cls[1:] != cls[:-1]).mean()) if n > 1 else 0.0,
        float((cls == 0).mean()), float((cls == 1).mean()), float((cls == 2).mean()), hexes / n, float((raw[1:] == raw[:-1]).mean()) if n > 1 else 0.0,
        covered / n, float(s.count("/") > 1 or before.endswith(("/", "://", "\\")) or text[end : end + 1] == "/"), s.count(".") / n,
        announced, otherwise, float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(before[-1:] in "\"'" and before[-1:] != ""),
        float(bool(re.fullmatch(r"[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}", low))), float(bool((cls == 0).all())),
        float((cls == 3).mean()), float(any(c in "()[]{}<>" for c in s)), float(text[end : end + 1] == "@" and before.endswith(":")), float(bool(PLACES.search(place))),
    ]


def _bare_end(text: str, start: int, end: int) -> int:
    """The end of an unquoted value without closing marks of the sentence or bracket it stands in."""
    while end > start and (text[end - 1] in ",;." or (text[end - 1] in _CLOSERS and text.find(_CLOSERS[text[end - 1]], start, end) < 0)):
        end -= 1
    return end


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of each candidate, in order, without overlap; assigned values and passwords go before long strings."""
    found = [m.span(1) for m in USERINFO.finditer(text)]
    for m in ASSIGNED.finditer(text):
        a, b = m.span("quoted") if m["quoted"] is not None else m.span("bare")
        found.append((a, b if m["quoted"] is not None else _bare_end(text, a, b)))
    found = sorted([(a, 0, b) for a, b in found if b - a >= 1] + [(m.start(), 1, m.end()) for m in LONG.finditer(text) if m.end() - m.start() >= 16])
    named = [(a, b) for a, kind, b in found if not kind]
    out, at, k = [], 0, 0
    for a, kind, b in found:
        while k < len(named) and named[k][1] <= a:
            k += 1
        if a >= at and not (kind and k < len(named) and named[k][0] < b):
            out.append((a, b))
            at = b
    return out


def made_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, int, int, int, str]]:
    """(text, start, length, 1 for a secret, place) of findings made by rule, in neighbourhoods of invented words.

    A third have no place; of the others, one in eight secrets and every second harmless string stand in tests, examples or documentation.

    Secrets stand quoted or bare after NAME=, NAME: or NAME, as passwords of addresses, and without
    any name before them. Bare hexadecimal is not among the latter: it is as often a checksum.
    """
    r = random.Random(seed)
    alnum, base64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    some = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    word = lambda: some(string.ascii_lowercase, r.randint(2, 9))
    prose = lambda: " ".join(word() for _ in range(r.randint(2, 6)))
    common = lambda k, by: by.join(r.choice(WORDS) for _ in range(k))
    keys = [
        lambda: some(alnum, r.randint(20, 44)), lambda: some(base64, r.choice([40, 43, 64])) + r.choice(["", "=", "=="]), lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16),
        lambda: word() + "_" + some(alnum, r.randint(24, 40)),
    ]
    hexes = lambda: some("0123456789abcdef", r.choice([16, 18, 20, 24, 32, 40, 64]))
    password = lambda: r.choice([lambda: some(alnum + "!#$%*-_?", r.randint(7, 20)), lambda: word().capitalize() + some(string.digits, r.randint(2, 4)) + word() + r.choice("!?#*"), lambda: word().capitalize() + "3" + some(string.ascii_letters, r.randint(3, 5))])()
    where = random.Random(seed + 1)  # places are drawn by themselves, so that the findings don't hang on them
    folders = ["tests", "test", "examples", "fixtures", "samples", "docs", "spec", "vendor"]
    out: list[tuple[str, int, int, int, str]] = []
    while len(out) < n:
        secret, right = r.random() < 0.5, ""
        name = r.choice(ANNOUNCE)
        assigned = [f'{name} = "', f"{name}: '", f'{word()}_{name}="', f"{name}=", f"{word()}_{name}=", f"{name}: ", f"{word()}{name.capitalize()}: ", f'"{name}": "']
        if secret:
            form = r.randrange(8)
            if form < 4:
                value, left = r.choice([hexes, *keys])(), r.choice([*assigned, f"{name} "])
                if left == f"{name} " and len(value) < 20:
                    left = f"{name}="
            elif form == 4:
                value, left = password(), r.choice(assigned)
            elif form == 5:
                value, left, right = password().replace("#", "-"), f"{word()}://{word()}:", f"@{word()}.example.com/{word()}"
            else:
                value, left = r.choice(keys)(), r.choice(["", "", '"', "("])
            while len(value) < 7:
                value += some(alnum, 1)
        else:
            shape = r.randrange(12)
            value = [
                lambda: some("0123456789", r.randint(16, 24)), lambda: some("0123456789abcdef", r.choice([32, 40, 64])), lambda: str(uuid.UUID(int=r.getrandbits(128))),
                lambda: r.choice(["", "/"]) + common(3, "/") + some("0123456789", 3) + ".html", lambda: common(3, "_") + some("0123456789", 2),
                lambda: r.choice(["x", "0", "1", "a"]) * r.randint(16, 30) + "0", lambda: f"20{some('0123456789', 2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T10.00.{r.randint(10, 59)}", lambda: word() + "." + word() + some("0123456789", 2) + ".example.com",
                lambda: r.choice(["", r.choice(WORDS)]) + some(string.ascii_lowercase, r.randint(6, 12)), lambda: r.choice(["${%s}", "<%s>", "{{%s}}", "get(%s)", "%s[name]", "your-%s-here", "changeme%s"]) % f"{r.choice(WORDS)}_{r.choice(WORDS)}",
                lambda: r.choice([some(string.ascii_lowercase, r.randint(16, 28)), "".join(w.capitalize() for w in common(5, " ").split()), word() + "-" + word() + "-" + some(string.ascii_lowercase, 12), common(4, "/")]), lambda: f"https://{word()}.example.com/{word()}/{some('0123456789', 3)}",
            ][shape]()
            while len(value) < 16 and shape not in (8, 9):
                value = r.choice(WORDS) + "_" + value
            if shape in (1, 2):
                left = r.choice([f"{w} " for w in OTHERWISE] + [f"{w}: " for w in OTHERWISE] + [f'{w}="' for w in OTHERWISE] + [f"{w}=" for w in OTHERWISE])
            elif shape in (4, 5):
                left = r.choice([f'{name} = "', f"{name}: ", f"{name}=", " "])
            elif shape in (8, 9, 11):
                left = r.choice(assigned)
            elif shape == 10:
                left = r.choice(["", "", " ", '"', f"{name} ", f"{r.choice(OTHERWISE)}: "])
            else:
                left = r.choice(["", " ", '"', f"{r.choice(OTHERWISE)} ", f"{r.choice(OTHERWISE)}="])
        if r.random() < 0.25:
            value, left = value.upper(), left.upper()
        head = prose() + " " + left
        text = head + value + (right or ('"' if left.endswith('"') else "'" if left.endswith("'") else ")" if left.endswith("(") else r.choice(["", "", "", ","]))) + " " + prose()
        assert (len(head), len(head) + len(value)) in candidates(text), text
        folder = where.choice(folders if where.random() < (0.125 if secret else 0.5) else ["src", "app", "lib", "deploy", "config"])
        out.append((text, len(head), len(value), int(secret), where.choice(["", *2 * [f"{where.choice(['web', 'api', 'core'])}/{folder}/main.{where.choice(['py', 'yml', 'env', 'js'])}"]])))
    return out


def neutral() -> Background:
    """The background where there is no corpus: the fixed words and their transitions."""
    return background_of(Counter(_SYMBOL[ord(a)] * SYMBOLS + _SYMBOL[ord(b)] for w in WORDS for a, b in zip(f" {w}", f"{w} ")), WORDS)


def labelled_findings(n: int = 3000, seed: int = 11, known: Background | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of made findings."""
    known, rows = known or neutral(), made_findings(n, seed)
    return np.array([describe(t, a, a + k, known, place) for t, a, k, _, place in rows]), np.array([y for *_, y, _ in rows])


class Forest:
    """Random forest: each tree is four arrays (feature, cut, left child, value); leaves point at themselves."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 5):
        g = np.random.default_rng(seed)
        self.depth, self.trees = depth, []
        tries = max(1, int(np.sqrt(x.shape[1])))
        for _ in range(trees):
            pick = g.integers(0, len(y), len(y))
            self.trees.append(self._grow(x[pick], y[pick].astype(float), g, tries, depth, least))

    @staticmethod
    def _grow(x, y, g, tries, depth, least):
        feature, cuts, left, value = [], [], [], []
        todo = [(np.arange(len(y)), 0)]
        for at, level in todo:
            me = len(feature)
            value.append(y[at].mean())
            feature.append(0)
            cuts.append(np.inf)
            left.append(me)
            if level == depth or len(at) < 2 * least or y[at].min() == y[at].max():
                continue
            best = (1e-12, 0, 0.0)
            for f in g.choice(x.shape[1], tries, replace=False):
                o = np.argsort(x[at, f], kind="stable")
                v, c = x[at, f][o], np.cumsum(y[at][o])
                k = np.arange(1, len(at))
                ok = (v[1:] > v[:-1]) & (k >= least) & (len(at) - k >= least)
                if ok.any():
                    n = len(at)
                    gain = np.where(ok, c[:-1] ** 2 / k + (c[-1] - c[:-1]) ** 2 / (n - k) - c[-1] ** 2 / n, -1)
                    b = int(np.argmax(gain))
                    if gain[b] > best[0]:
                        middle = (v[b] + v[b + 1]) / 2
                        best = (gain[b], f, middle if middle < v[b + 1] else v[b])
            if best[0] > 1e-12:
                feature[me], cuts[me], left[me] = best[1], best[2], len(todo)
                go = x[at, best[1]] <= best[2]
                todo += [(at[go], level + 1), (at[~go], level + 1)]
        return np.array(feature), np.array(cuts), np.array(left), np.array(value)

    def probability(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cuts, left, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = left[at] != at
                at = np.where(inner, left[at] + (x[rows, feature[at]] > cuts[at]), at)
            out += value[at]
        return out / len(self.trees)


@dataclass(frozen=True)
class Judge:
    """What the corpus says, and a forest that knows findings by it."""

    known: Background
    forest: Forest

    def spans(self, texts: list[str], places: list[str]) -> list[list[tuple[int, int, float]]]:
        return judge(texts, self.forest, self.known, places)


def judge(texts: list[str], forest: Forest, known: Background | None = None, places: list[str] | None = None) -> list[list[tuple[int, int, float]]]:
    """(start, end, probability) of each candidate of each text."""
    known = known or neutral()
    spans = [candidates(t) for t in texts]
    x = [describe(t, a, b, known, place) for t, place, s in zip(texts, places or [""] * len(texts), spans) for a, b in s]
    p = iter(forest.probability(np.array(x)).tolist() if x else [])
    return [[(a, b, next(p)) for a, b in s] for s in spans]


@lru_cache(1)
def default_forest() -> Forest:
    """A forest for the neutral background."""
    return Forest(*labelled_findings())


def train(docs: DataFrame, findings: DataFrame | None = None, most: int = 20_000) -> Judge:
    """A judge for the corpus, trained from labelled findings (text, start, length, is_secret, optional place).

    Of more than ``most`` findings those of least hash are learned from; rows with a null among
    text, start, length and is_secret, or a span outside the text, are left out. Without
    findings, 10,000 made by rule serve (made_findings).
    """
    known = learn(docs)
    if findings is None:
        rows = made_findings(10_000)
    else:
        place = F.coalesce(F.col("place").cast("string"), F.lit("")) if "place" in findings.columns else F.lit("")
        given = findings.select(F.col("text").cast("string").alias("text"), F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), F.col("is_secret").cast("int").alias("y"), place.alias("place"))
        given = given.where("start >= 0 and length > 0 and start + length <= length(text) and y is not null")
        rows = [tuple(r) for r in least_hashed(given.withColumn("key", F.xxhash64("text", "start", "length")), "key", most).drop("key").collect()]
    if len({y for *_, y, _ in rows}) < 2:
        raise ValueError("findings of both kinds are needed")
    return Judge(known, Forest(np.array([describe(t, a, a + n, known, place) for t, a, n, _, place in rows]), np.array([y for *_, y, _ in rows])))


_FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("probability", pa.float64()), ("is_secret", pa.bool_())])


def scan(docs: DataFrame, judged_by: Judge | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per candidate of every whole text: doc_id, start and length in characters, probability, is_secret.

    Null and empty texts have no candidates; repeated rows give theirs again; a row
    without doc_id gives candidates with a null doc_id. A column ``source`` is taken as the
    place of a text; other columns are not read.
    """
    by = judged_by or train(docs)
    place = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                found = by.spans([t or "" for t in part.column(1).to_pylist()], part.column(2).to_pylist())
                rows = [(d, s, e - s, p, p >= threshold) for d, f in zip(part.column(0).to_pylist(), found) for s, e, p in f]
                yield batch({n: [r[i] for r in rows] for i, n in enumerate(_FOUND.names)}, _FOUND)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), place.alias("place")).mapInArrow(tidy(run), "doc_id long, start long, length long, probability double, is_secret boolean")


def redact(docs: DataFrame, judged_by: Judge | None = None, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each secret replaced by ``mark``; rows without one pass unchanged, columns stay."""
    by = judged_by or train(docs)
    where = docs.columns.index("text")
    source = docs.columns.index("source") if "source" in docs.columns else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                texts = part.column(where).to_pylist()
                places = [str(p or "") for p in part.column(source).to_pylist()] if source is not None else [""] * len(texts)
                out = []
                for t, found in zip(texts, by.spans([t or "" for t in texts], places)):
                    for s, e, p in reversed(found):
                        if p >= threshold:
                            t = t[:s] + mark + t[e:]
                    out.append(t)
                columns = [pa.array(out, b.schema.field(where).type) if i == where else part.column(i) for i in range(len(b.schema.names))]
                yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(tidy(run), docs.schema)
