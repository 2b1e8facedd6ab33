"""Language identification by fusing independent evidence in Bayes' rule.

log P(lang | all) = text log-likelihood + log P(declared | lang) + log prior(host),
where the text model is naive Bayes on hashed byte trigrams of letters, the
declaration (a page's markup) is weighed by how often it agrees with the text over
the whole corpus, and a host's prior is its grouped text evidence, smoothed
towards that of its address suffix, and that towards the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.bytesio import LOWER, slices, tidy
from pagemill.llm.spark import batch, cut, session

HASH_BITS = 14
UNKNOWN = "und"
#: A text counts as this many independent trigrams at most; neighbours are far from independent.
EFFECTIVE = 48
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigram, owner): letters in lower case, one blank for anything else, no gram of mostly blanks."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = LOWER[data]
    solid = _LETTER[low]
    low = np.where(solid, low, 32).astype(np.uint32)
    own = np.repeat(np.arange(len(off) - 1), np.diff(off))
    ok = (own[2:] == own[:-2]) & (solid[:-2].astype(np.int8) + solid[1:-1] + solid[2:] >= 2)
    code = (low[:-2] | low[1:-1] << 8 | low[2:] << 16) * np.uint32(2654435761) >> np.uint32(32 - HASH_BITS)
    return code[ok].astype(np.int64), own[:-2][ok]


_COUNTS = pa.schema([("lang", pa.string()), ("code", pa.int32()), ("n", pa.int64())])


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for rows, data, off in slices(batches):
        code, own = grams(data, off)
        names = rows.column(rows.schema.get_field_index("lang")).to_pylist()
        langs = sorted(set(names))
        which = np.searchsorted(langs, names)[own]
        for i, x in enumerate(langs):
            total[x] = total.get(x, 0) + np.bincount(code[which == i], minlength=1 << HASH_BITS)
    for x, n in total.items():
        at = np.flatnonzero(n)
        yield batch({"lang": [x] * len(at), "code": at, "n": n[at]}, _COUNTS)


def fit_text_model(docs: DataFrame, label: str = "lang", each: int = 1000) -> tuple[list[str], np.ndarray]:
    """(languages, log P(trigram | language)) of every language that labels a row with text.

    The languages come from a grouped count over all rows. Of each, the rows of least hash are
    learned from: all up to ``each`` rows, of more a share of ``each`` on average, one at least.
    """
    known = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("lang"), F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), 1).alias("h"))
    seen = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).select("lang", F.when(F.col("n") <= each, F.lit((1 << 63) - 1)).otherwise(F.greatest("least", (F.lit(float(1 << 63)) * each / F.col("n")).cast("long"))).alias("most")).collect()
    langs = sorted(r["lang"] for r in seen)
    if not langs:
        return [], np.zeros((0, 1 << HASH_BITS), np.float32)
    below = session(docs).createDataFrame([(r["lang"], r["most"]) for r in seen], "lang string, most long")
    sample = known.join(F.broadcast(below), "lang").where("h <= most").select("text", "lang")
    counts = sample.repartition(16).mapInArrow(tidy(_counts), "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    total = np.full((len(langs), 1 << HASH_BITS), 0.5)
    at = {x: i for i, x in enumerate(langs)}
    total[[at[x] for x in counts["lang"].to_pylist()], counts["code"].to_numpy()] += counts["n"].to_numpy()
    return langs, np.log(total / total.sum(1, keepdims=True)).astype(np.float32)


_TEXT = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("declared", pa.string()), ("suffix", pa.string()), ("n_grams", pa.int64()), ("ll", pa.list_(pa.float64()))])


def _likelihood(table: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in slices(batches, most=1 << 20):
            code, own = grams(data, off)
            n = np.bincount(own, minlength=rows.num_rows)
            mean = np.stack([np.bincount(own, weights=t[code], minlength=rows.num_rows) for t in table], 1) / np.maximum(n, 1)[:, None]
            ll = mean * np.minimum(n, EFFECTIVE)[:, None]
            get = lambda c: rows.column(rows.schema.get_field_index(c))  # noqa: E731, B023
            yield batch({c: get(c) for c in ("doc_id", "host", "declared", "suffix")} | {"n_grams": n, "ll": pa.ListArray.from_arrays(np.arange(0, ll.size + 1, len(table), dtype=np.int32), ll.reshape(-1))}, _TEXT)

    return run


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _posterior(logits: Column) -> Column:
    """exp and normalise an array of log weights."""
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda acc, y: acc + y))


def _sums(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Grouped sums of the posterior p, as an array c."""
    return df.groupBy(*keys).agg(*[F.sum(F.get("p", F.lit(i))).alias(f"c{i}") for i in range(k)]).select(*keys, F.array(*[f"c{i}" for i in range(k)]).alias("c"))


def identify(docs: DataFrame, langs: list[str], table: np.ndarray, host: Column, declared: Column, suffix: Column, key: str = "doc_id", strength: float = 20.0, least: float = 0.6) -> DataFrame:
    """key, lang, probability, kept.

    A declared language is its primary subtag in lower case. A row without letters in its
    text, or whose best language has a probability below ``least``, is ``und`` and
    not kept. Null host, declaration or suffix is no evidence (their own group).
    With no learned language every row is ``und``.
    """
    k = len(langs)
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), host.cast("string").alias("host"), F.lower(F.regexp_extract(declared.cast("string"), "^[A-Za-z]{2,3}", 0)).alias("declared"), suffix.cast("string").alias("suffix"))
    if not k:
        return src.select(F.col("doc_id").alias(key), F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("probability"), F.lit(False).alias("kept"))
    src = src.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "declared", "suffix")})
    rows = cut(src.mapInArrow(tidy(_likelihood(table)), "doc_id long, host string, declared string, suffix string, n_grams long, ll array<double>"))
    sure = rows.where("n_grams > 0").withColumn("p", _posterior(F.col("ll")))
    by_host = cut(_sums(sure, ["suffix", "host", "declared"], k))
    add = lambda df, keys: df.groupBy(*keys).agg(*[F.sum(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(k)]).select(*keys, F.array(*[f"c{i}" for i in range(k)]).alias("c"))
    total = [1.0 + (x or 0.0) for x in (add(by_host, []).first()["c"] or [0.0] * k)]
    whole = F.array(*[F.lit(x / sum(total)) for x in total])
    smooth = lambda c, up: F.zip_with(c, up, lambda x, u: (x + strength * u) / (F.aggregate(c, F.lit(0.0), lambda a, y: a + y) + strength))
    at_suffix = add(by_host, ["suffix"]).select("suffix", smooth(F.col("c"), whole).alias("up"))
    prior = add(by_host, ["suffix", "host"]).join(at_suffix, "suffix").select("suffix", "host", F.transform(smooth(F.col("c"), F.col("up")), lambda x: F.ln(x)).alias("prior"))
    said = add(by_host, ["declared"])
    n_said = said.count()
    per_lang = F.array(*[F.lit(x) for x in total])
    claim = said.select("declared", F.when(F.col("declared") == "", F.array(*[F.lit(0.0)] * k)).otherwise(F.zip_with("c", per_lang, lambda x, t: F.ln((x + 0.5) / (t + 0.5 * n_said)))).alias("claim"))
    joined = rows.join(prior, ["suffix", "host"], "left").join(claim, "declared", "left")
    nothing = F.array(*[F.lit(0.0)] * k)
    post = joined.withColumn("post", _posterior(_plus(_plus(F.col("ll"), F.coalesce("prior", nothing)), F.coalesce("claim", nothing)))).withColumn("probability", F.array_max("post"))
    kept = (F.col("n_grams") > 0) & (F.col("probability") >= least)
    best = F.get(F.array(*[F.lit(x) for x in langs]), (F.array_position("post", F.col("probability")) - 1).cast("int"))
    return post.select(F.col("doc_id").alias(key), F.when(kept, best).otherwise(UNKNOWN).alias("lang"), "probability", kept.alias("kept"))


def identify_documents(docs: DataFrame, key: str = "doc_id", model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """documents: text and host (source) are the evidence.

    lang labels the rows that the text model learns from, a bounded sample of each language; so it is
    no evidence of the same rows. Documents have neither markup nor an address.
    """
    return identify(docs, *(model or fit_text_model(docs)), F.col("source"), F.lit(None), F.lit(None), key)


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, host, declared markup language and address suffix of pages(page_id, url, html)."""
    html, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.coalesce(F.col("url").cast("string"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1))
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/]+/([a-z]{2})(?:[/?#]|$)", 1)
    suffix = F.when(path != "", path).otherwise(F.regexp_extract(host, r"([^.]+)$", 1))
    return pages.select("page_id", bare.alias("text"), host.alias("host"), F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("declared"), suffix.alias("suffix"))


def identify_pages(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    return identify(page_evidence(pages), langs, table, F.col("host"), F.col("declared"), F.col("suffix"), "page_id")


def identify_all(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, lang, probability, kept, page_id: a row for each document (page_id is null) and each page (doc_id is null).

    One text model, learned from the documents, serves both; the evidence of pages is their own.
    """
    model = fit_text_model(docs)
    none = F.lit(None).cast("long")
    found = identify_documents(docs, model=model).withColumn("page_id", none)
    return found.unionByName(identify_pages(pages, *model).withColumn("doc_id", none))
