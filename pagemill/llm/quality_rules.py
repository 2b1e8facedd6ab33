"""Quality rules in DataFrame expressions: text measures and cross-document line frequency.

Every measure is computed inside its row, once: measures and line hashes are
written to a table, and what follows reads its columns. Only line hashes cross the
network: (host, line) counts are pre-aggregated, and the lines of a frequent pair come
back through a join whose hot keys Spark may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.spark import cut

#: Characters that separate words, and their class in a pattern.
BLANKS = " \t\n\x0b\f\r"
BLANK = r"[\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    """Words of a text: maximal runs without blanks; none for null or blank text."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, BLANK + "+"))


def repeated_words(words: Column) -> Column:
    """How many words stand in a 5-word window that the text holds twice or more."""

    def of_hashes(h: Column) -> Column:
        windows = F.when(F.size(h) >= 5, F.transform(F.slice(h, 1, F.size(h) - 4), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), F.get(h, i + 4)))).otherwise(F.array().cast("array<long>"))
        return let(windows, of_windows)

    def of_windows(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted))

    def of_sorted(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def covered(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, 2, F.size(p)), F.slice(p, 1, F.size(p) - 1), lambda b, a: F.least(b - a, F.lit(5)))
        return F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(5), lambda acc, g: acc + g))

    return let(F.transform(words, lambda x: F.xxhash64(x)), of_hashes).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, host, the measures of each text; two hashes and the size of each distinct normalised line."""
    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), text.alias("text"))
    d = d.withColumn("words", split_words(F.col("text"))).withColumn("lines", F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0))
    return d.select(
        "doc_id", "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.transform(F.array_distinct(F.transform("lines", lambda x: normalised(x))), lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(x, F.lit(1)).alias("h2"), F.length(x).alias("size"))).alias("norm"),
    )


def normalised(line: Column) -> Column:
    """A line as it is counted: outer blanks cut, digit runs as 0."""
    return F.regexp_replace(F.btrim(line, F.lit(BLANKS)), "[0-9]+", "0")


def apply_rules(docs: DataFrame, most_docs: int = 50, least_left: int = 30) -> DataFrame:
    """Text measures, the base rule, and the verdict of cross-document line frequency.

    A normalised line that more than ``most_docs`` documents of a host hold is
    removed from all of them but the one with the least doc_id; a document left with
    less than ``least_left`` percent of the characters of its distinct lines
    is depleted. ``kept`` is false where the base rule fails or the document is
    depleted. Null text has no words; a null source is the host ''. A repeated row
    counts as another document and is judged for itself (a row without doc_id loses
    no lines); other columns are not read.
    """
    m = cut(measures(docs).withColumn("row", F.monotonically_increasing_id()))
    lines = m.where("n_words > 0").select("row", "doc_id", "host", F.inline("norm"))
    often = lines.groupBy("host", "h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") > most_docs).drop("n")
    gone = lines.join(often, ["host", "h1", "h2"]).where("doc_id > first").groupBy("row").agg(F.sum("size").alias("gone"))
    out = m.withColumn("size", F.aggregate("norm", F.lit(0).cast("long"), lambda acc, x: acc + x["size"])).drop("norm").join(gone, "row", "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = 100 * (F.col("size") - F.coalesce("gone", F.lit(0))) >= least_left * F.col("size")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & left).alias("kept"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win FROM w),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g),
p AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM c WHERE n > 1),
r AS (SELECT doc_id, sum(CASE WHEN nxt IS NULL OR nxt - i > 5 THEN 5 ELSE nxt - i END) AS n_repeat_words FROM p GROUP BY doc_id),
l AS (SELECT DISTINCT doc_id, host, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[0-9]+', '0', 'g') AS line
      FROM (SELECT doc_id, host, unnest(lines) AS line FROM d)),
f AS (SELECT host, line, min(doc_id) AS first FROM l GROUP BY host, line HAVING count(*) > 50),
s AS (SELECT l.doc_id, sum(length(l.line)) AS size, sum(CASE WHEN f.first < l.doc_id THEN length(l.line) ELSE 0 END) AS gone
      FROM l LEFT JOIN f ON l.host = f.host AND l.line = f.line GROUP BY l.doc_id),
m AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        coalesce(100 * (size - gone) >= 30 * size, true) AS enough
      FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN s ON d.doc_id = s.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND enough) AS kept
FROM m
"""
