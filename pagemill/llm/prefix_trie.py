"""The prefix trie of rebuilt conversations, from chained digests.

Only digests and sizes of turns cross the network. A conversation's prefixes have chained SHA-256
digests; every prefix is a row, and rows of one digest are a node. A node's owner is its smallest
member, so (owner, depth) names it as well, and the nodes that a conversation owns are a lower end of
its path. Each node is then counted at all its ancestors: what one owner's nodes add to a depth is
summed along the path first, so a conversation of n turns sends n + 1 rows, not n².
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.merkle import CRC32
from pagemill.llm.spark import cut
from pagemill.operators.scan import numbered, running

#: Turns of a segment: the digests of one are chained in a row; those of a longer conversation segment by segment.
SEGMENT = 256
#: Conversation ids of one piece of a list that is hashed.
PIECE = 4096
ROOT = hashlib.sha256(b"").digest()


def _sha(*parts) -> F.Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, n, mark, size): each turn's place in its conversation, the digest of role and text, the bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = _sha(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    t = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), mark.alias("mark"), F.octet_length(text).cast("long").alias("size"))
    return cut(numbered(cut(t), ["conv_id"], ["turn", "role", "mark"], total="n").select("conv_id", "pos", "n", "mark", "size"))


def rebuilt(t: DataFrame, within: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns of rebuilt conversations (conv_id, pos, mark, size, len), and all conversations (conv_id, len)."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    convs = t.where("pos = 0").select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % within).alias("base"))
    sizes = t.where((F.col("pos") == 0) & (F.col("conv_id") % within == 0)).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    info = convs.join(sizes, "base", "left").select("conv_id", "n", "h", "base", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    info = cut(info.withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    # a conversation of very many turns meets its own row in blocks of turns
    block = info.select(F.col("conv_id").alias("_c"), "h", "taken", "len", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE))).alias("_b"))
    own = t.join(block, (F.col("conv_id") == F.col("_c")) & (F.floor(F.col("pos") / PIECE) == F.col("_b"))).where("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "mark", "size", "len")
    first = t.where((F.col("pos") < most - 1) & (F.col("conv_id") % within == 0)).select(F.col("conv_id").alias("base"), "pos", "mark", "size")
    lent = info.join(first, "base").where("pos < h").select("conv_id", "pos", "mark", "size", "len")
    return own.unionByName(lent), info.select("conv_id", "len")


def chained(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, pos, mark, rest) -> (conv_id, rest, digest, parent): the digest of marks 0 to pos, and of 0 to pos - 1.

    Marks of a segment are chained in its row; a later segment's digests are hashed with the chain of the
    segments before it. So no row holds more than a segment, and equal prefixes have equal digests.
    """
    rest = [c for c in rows.columns if c not in ("conv_id", "mark")]
    local = F.aggregate("t", F.array(F.lit(ROOT)), lambda acc, x: F.concat(acc, F.array(_sha(F.element_at(acc, -1), x["mark"]))))
    s = rows.groupBy("conv_id", F.floor(F.col("pos") / segment).alias("seg")).agg(F.sort_array(F.collect_list(F.struct("pos", "mark", *[c for c in rest if c != "pos"]))).alias("t"))
    s = cut(s.withColumn("d", local).withColumn("t", F.transform("t", lambda x: F.struct(*[x[c].alias(c) for c in rest]))))
    pair = lambda before: F.transform("t", lambda x, i: F.struct(*[x[c].alias(c) for c in rest], F.get("d", i + 1).alias("digest"), (F.when((i == 0) & (F.col("seg") > 0), before).otherwise(F.get("d", i)) if before is not None else F.get("d", i)).alias("parent")))
    if not s.where("seg > 0").take(1):
        return s.select("conv_id", F.inline(pair(None)))
    over = chained(s.select("conv_id", F.col("seg").alias("pos"), F.element_at("d", -1).alias("mark")), segment)
    over = over.select("conv_id", (F.col("pos") + 1).alias("seg"), F.col("digest").alias("before"))
    s = s.join(over, ["conv_id", "seg"], "left").withColumn("d", F.when(F.col("seg") == 0, F.col("d")).otherwise(F.transform("d", lambda x: _sha(F.col("before"), x)))).drop("before")
    s = cut(s)
    last = s.select("conv_id", (F.col("seg") + 1).alias("seg"), F.element_at("d", -1).alias("before"))
    return s.join(last, ["conv_id", "seg"], "left").select("conv_id", F.inline(pair(F.col("before"))))


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, pos, ids) in order -> one SHA-256 a digest, fed piece by piece."""
    now, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["digest", "ends"])

    for batch in batches:
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if key != now:
                if state is not None:
                    yield row()
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state is not None:
        yield row()


def list_hashes(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """(digest, conv_id) -> (digest, ends): SHA-256 of each digest's ids, ascending, comma-joined.

    Lists are written in pieces of ``piece`` ids. Where there are several, they pass one task in order, as one SHA-256
    must; it holds one piece at a time.
    """
    n = numbered(ends, ["digest"], ["conv_id"], total="n").select("digest", "conv_id", F.floor(F.col("pos") / piece).alias("pos"), "n")
    pieces = cut(n.groupBy("digest", "pos").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"), F.max("n").alias("n")))
    one = pieces.where(F.col("n") <= piece).select("digest", F.sha2("ids", 256).alias("ends"))
    many = pieces.where(F.col("n") > piece).select("digest", "pos", "ids").repartition("digest").sortWithinPartitions("digest", "pos")
    return one.unionByName(many.mapInArrow(_hashed, "digest binary, ends string"))


def trie(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Turns ascend (null first; those of one number by role, then by the digest of role and text; repeated rows are turns of their
    own); a null role or text is empty. Rows without conv_id belong to no conversation. An empty table
    has no conversations and no node. Other columns are not read.
    """
    rows, convs = rebuilt(turns(conversations))
    chain = chained(rows, segment).select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "parent", "size", (F.col("pos") + 1 == F.col("len")).alias("end"))
    none = F.lit(None).cast("binary")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest"), none.alias("parent"), F.lit(0).cast("long").alias("size"), (F.col("len") == 0).alias("end"))
    prefixes = cut(chain.unionByName(roots))
    nodes = cut(prefixes.groupBy("depth", "digest", "parent", "size").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")))
    kids = cut(nodes.where("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children")))
    nodes = cut(nodes.join(kids, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))

    worth = nodes.select("conv_id", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    path = cut(prefixes.select("conv_id", "depth", "digest").join(worth, ["conv_id", "depth"], "left").withColumn("up", -F.col("depth")))
    sums = running(path, ["conv_id"], ["up"], {"n_leaves": F.col("leaf"), "saved_tokens": F.col("saved")})
    sums = sums.where("n_leaves > 0 or saved_tokens <> 0").groupBy("digest").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    # parents of over a thousandth of all nodes are at most 1,000; others meet few children
    least = F.lit(max(PIECE, nodes.count() // 1000))
    upper = nodes.where("n_children > 0").select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") > least).alias("many"))
    hot = F.broadcast(upper.where("many").drop("many"))
    found = nodes.join(hot, "parent").unionByName(nodes.join(hot, "parent", "left_anti").join(upper.where("not many").drop("many"), "parent", "left").select("parent", *[c for c in nodes.columns if c != "parent"], "parent_conv_id"))
    out = found.join(sums, "digest").join(list_hashes(cut(prefixes.where("end").select("digest", "conv_id"))), "digest", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(mark ORDER BY turn NULLS FIRST, role, mark) AS marks, list(strlen(text) ORDER BY turn NULLS FIRST, role, mark) AS sizes, {CRC32.format('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(b.marks, [])[1:c.h], c.marks[c.h + 1:]) AS marks, list_concat(coalesce(b.sizes, [])[1:c.h], c.sizes[c.h + 1:]) AS sizes FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, marks, sizes, unnest(range(0, len(marks) + 1)) AS depth FROM r),
n AS (SELECT depth, array_to_string(marks[1:depth], '') AS k, CASE WHEN depth > 0 THEN array_to_string(marks[1:depth - 1], '') END AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
             any_value(CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END) AS size, sha256(coalesce(string_agg(CASE WHEN len(marks) = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM p GROUP BY ALL),
k AS (SELECT up, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY up),
m AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.k),
s AS (SELECT a.k, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.size) AS saved FROM m a JOIN m b ON starts_with(b.k, a.k) GROUP BY a.k)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s ON m.k = s.k LEFT JOIN m q ON q.k = m.up
"""
