"""A Merkle tree over a dataset, collapsed by higher-order SQL functions in blocks of leaves.

Nodes of a group are numbered by the two-pass scan, dealt into blocks of ``fan ** levels``
consecutive ones, and each block (an ordered array) is collapsed level by level with sequence,
transform, slice and aggregate. Block roots are the nodes of the next pass, until each group has one.
A block holds a fixed number of digests, whatever the size of its group; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.quality_rules import let
from pagemill.llm.spark import cut
from pagemill.operators.scan import numbered

#: Levels that one pass collapses: blocks of 1,024 leaves where two nodes make one.
LEVELS = 10


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)


def field(value: Column) -> Column:
    """`-` for null, else the byte count of the value's text, `:` and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _runs(level: Column, fan: int) -> Column:
    """A level's digests -> the next level: each ``fan`` consecutive ones become one, also a last run of fewer."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / fan).cast("int")), lambda i: digest(F.array_join(F.slice(level, i * fan + 1, fan), "")))


def _steps(level: Column, fan: int) -> Column:
    """For each node of a level, what stands before and after it in its run."""

    def step(_: Column, i: Column) -> Column:
        r = (i % fan).cast("int")
        return F.struct(F.array_join(F.slice(level, i - r + 1, r), "").alias("before"), F.array_join(F.slice(level, i + 2, F.lit(fan - 1) - r), "").alias("after"))

    return F.transform(level, step)


def fold(node: Column, path: Column) -> Column:
    """The root that a node and the steps of its path give."""
    return F.aggregate(path, node, lambda acc, s: digest(s["before"], acc, s["after"]))


def proof(path: Column) -> Column:
    """One digest over all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def _collapsed(nodes: DataFrame, key: list[str], fan: int, levels: int, extra: tuple[str, ...]) -> DataFrame:
    """(key, pos, n, node, extra) -> (key, block, top, n, nodes: array of (path, pos, node, extra)): one pass over blocks.

    A group of more than one block collapses by ``levels`` in each; one that fits into a block, down to its root.
    """
    size = fan**levels
    blocks = nodes.groupBy(*key, F.floor(F.col("pos") / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "node", *extra))).alias("leaves"), F.max("n").alias("n"))
    fewer = lambda a, _: F.when(a["left"] > 1, F.struct((a["k"] + 1).alias("k"), F.floor((a["left"] + fan - 1) / fan).alias("left"))).otherwise(a)
    need = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.struct(F.lit(0).alias("k"), F.col("n").alias("left")), fewer, lambda a: a["k"])
    turns = F.when(F.col("todo") > 0, F.sequence(F.lit(1), F.col("todo"))).otherwise(F.array().cast("array<int>"))
    powers = F.array(*[F.lit(fan**l) for l in range(levels)])
    b = blocks.withColumn("todo", F.when(F.col("n") > size, levels).otherwise(need))

    def entries(steps: Column) -> Column:
        path = lambda i: F.transform(steps, lambda level, l: F.get(level, F.floor(i / F.get(powers, l)).cast("int")))
        return F.transform("leaves", lambda x, i: F.struct(path(i).alias("path"), *[x[c].alias(c) for c in ("pos", "node", *extra)]))

    def whole(tree: Column) -> Column:
        steps = F.transform(F.slice(tree, 1, F.col("todo")), lambda level: _steps(level, fan))
        return F.struct(F.element_at(F.element_at(tree, -1), 1).alias("top"), let(steps, entries).alias("nodes"))

    # let: the levels and their steps are made once a block, not once a leaf
    tree = F.aggregate(turns, F.array(F.transform("leaves", lambda x: x["node"])), lambda acc, _: F.concat(acc, F.array(let(F.element_at(acc, -1), lambda level: _runs(level, fan)))))
    return b.select(*key, "block", "n", let(tree, whole).alias("b")).select(*key, "block", "n", "b.top", "b.nodes")


def passes(nodes: DataFrame, key: list[str], fan: int = 2, levels: int = LEVELS, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(key, pos from 0, n nodes of the key, node, extra) -> nodes (key, block, path, pos, node, extra) and blocks (key, block, above, top).

    ``path`` leads from a node to its block's root and ``above`` from there to the group's (``top``): arrays of
    (before, after), the run's other digests, joined. A group of one node has empty paths and is its own root.
    Passes grow with the logarithm of the largest group to the base of the block size.
    """
    done = cut(_collapsed(nodes, key, fan, levels, extra))
    flat = done.select(*key, "block", F.inline("nodes"))
    if not done.where("block > 0").take(1):
        return flat, done.select(*key, "block", F.array().cast("array<struct<before:string,after:string>>").alias("above"), "top")
    upper = done.select(*key, F.col("block").alias("pos"), F.ceil(F.col("n") / fan**levels).alias("n"), F.col("top").alias("node"))
    return flat, trees(upper, key, fan, levels).withColumnsRenamed({"pos": "block", "path": "above"})


def _joined(flat: DataFrame, blocks: DataFrame, key: list[str]) -> DataFrame:
    """Each node with what its block has: a block is one row there, and a bounded number here."""
    mine = [k for k in (*key, "block")]
    other = blocks.withColumnsRenamed({k: f"_{k}" for k in mine})
    return flat.join(other, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in mine]).drop(*[f"_{k}" for k in mine])


def trees(nodes: DataFrame, key: list[str], fan: int = 2, levels: int = LEVELS, extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, pos, n, node, extra) -> (key, pos, path, top, extra): each node's steps up to its group's root."""
    j = _joined(*passes(nodes, key, fan, levels, extra), key)
    return j.select(*key, "pos", F.concat("path", "above").alias("path"), "top", *extra)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered): the digest of each row, and that of the row with 1 added to n_chars where 7 divides the CRC-32 of its id."""
    d = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    head = lambda n: F.concat(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(n))
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    text = field(F.col("text"))
    return d.select("doc_id", "lang", digest(head(F.col("n_chars")), text).alias("leaf"), F.when(hit, digest(head(F.col("n_chars") + 1), text)).alias("tampered"))


def manifest(docs: DataFrame, fan: int = 2, levels: int = LEVELS) -> DataFrame:
    """Per row: its leaf, the roots of its language and of the dataset, the digest of its proof, and whether it verifies.

    Leaves of a language ascend by doc_id (null first); rows that share one stand by the hexadecimal digits of their leaf, so
    repeated rows are leaves of their own. A null lang is a language, before all others. A null
    doc_id is a leaf like others and never tampered with. An empty table gives no rows; other columns are
    not read. ``folded_root`` is recomputed from the (where tampered with: changed) leaf and the original siblings.
    """
    placed = cut(numbered(cut(leaves(docs)), ["lang"], ["doc_id", "leaf"], total="n"))
    flat, blocks = passes(placed.withColumnRenamed("leaf", "node"), ["lang"], fan, levels, ("doc_id", "tampered"))
    tops = cut(blocks.where("block = 0").select("lang", "top", F.lit(0).alias("all")))
    ranked = cut(numbered(tops, ["all"], ["lang"], total="n").withColumnRenamed("top", "node"))
    over = trees(ranked, ["all"], fan, levels, ("lang",)).select(F.col("lang").alias("_lang"), F.col("path").alias("_over"), F.col("top").alias("root"))
    blocks = blocks.join(over, F.col("lang").eqNullSafe(F.col("_lang"))).select("lang", "block", F.concat("above", "_over").alias("above"), "top", "root")
    whole = F.concat("path", "above")
    out = _joined(flat, cut(blocks), ["lang"]).select(
        "doc_id", F.col("node").alias("leaf"), F.col("top").alias("subroot"), "root",
        proof(whole).alias("proof_sha256"), fold(F.coalesce("tampered", "node"), whole).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Unsigned CRC-32 of a column of ASCII strings, bit by bit.
CRC32 = "xor(4294967295, list_reduce(list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda d, _: xor(d >> 1, 3988292384 * (d & 1)), xor(a, b)), 4294967295))"
_FIELD = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
_LEAF = lambda n: f"sha256({_FIELD('doc_id')} || {_FIELD('source')} || {_FIELD('lang')} || {_FIELD(n)} || {_FIELD('text')})"

ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_LEAF('n_chars')} AS leaf,
         CASE WHEN {CRC32.format('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_LEAF('n_chars + 1')} ELSE {_LEAF('n_chars')} END AS given FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
lv AS (
  SELECT lang, 0 AS k, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY lang
  UNION ALL SELECT lang, k + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(array_to_string(nodes[i:i + 1], ''))) FROM lv WHERE len(nodes) > 1),
sub AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang COLLATE C NULLS FIRST) - 1 AS pos FROM lv WHERE len(nodes) = 1),
tv AS (
  SELECT 0 AS k, list(subroot ORDER BY pos) AS nodes FROM sub
  UNION ALL SELECT k + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(array_to_string(nodes[i:i + 1], ''))) FROM tv WHERE len(nodes) > 1),
st AS (
  SELECT doc_id, leaf, given, p.lang, k, p.pos >> k AS j, nodes FROM p JOIN lv ON p.lang IS NOT DISTINCT FROM lv.lang WHERE len(nodes) > 1
  UNION ALL SELECT doc_id, leaf, given, p.lang, k + 1000, sub.pos >> k, nodes FROM p JOIN sub ON p.lang IS NOT DISTINCT FROM sub.lang, tv WHERE len(nodes) > 1),
sb AS (SELECT doc_id, leaf, given, lang, list(CASE WHEN j % 2 = 1 THEN 'L' || nodes[j] ELSE 'R' || coalesce(nodes[j + 2], '') END ORDER BY k) AS s FROM st GROUP BY ALL),
f AS (SELECT p.doc_id, p.leaf, p.lang, sha256(coalesce(array_to_string(list_transform(s, lambda x: x[2:]), ''), '')) AS proof_sha256,
             coalesce(list_reduce(s, lambda a, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || a ELSE a || x[2:] END), p.given), p.given) AS folded_root
      FROM p LEFT JOIN sb ON p.doc_id IS NOT DISTINCT FROM sb.doc_id AND p.leaf = sb.leaf AND p.lang IS NOT DISTINCT FROM sb.lang)
SELECT doc_id, leaf, subroot, nodes[1] AS root, proof_sha256, folded_root, folded_root = nodes[1] AS verified
FROM f JOIN sub ON f.lang IS NOT DISTINCT FROM sub.lang, tv WHERE len(nodes) = 1
"""
