"""Exact removal of repeated passages by prefix-free parsing and suffix order.

1. What may stand twice in a block of texts (windows whose trigger, see 2, the block
   holds more than once) is put in corpus order by prefix-free parsing (pfp.py: dictionary
   of phrases, its suffix array, that of the parse, both combined). Neighbours that share
   ``width`` bytes are one string; all its places in the block but the first are
   repeats, and go no further.
2. What is left meets across blocks. Each window start belongs to the phrase of its
   trigger, the least gram hash in its window (winnow.py), so equal windows have
   equal triggers wherever they stand. Phrases meet at their trigger, one row a
   block at most for equal ones; of equal phrases only the first can hold first occurrences.
3. Where a trigger has several different phrases, their windows are put in
   corpus order, again by prefix-free parsing, and the least (doc_id, start) of
   equal neighbours is the first occurrence. A trigger
   with very many different phrases (neighbours of a passage that a third of the
   corpus holds) is spread over parts, each part keeps its first occurrences,
   and these meet once more, a row for each window, in a partial aggregation.
4. Spans are gathered per document and cut out.

What crosses the network is hashes and positions, in packed arrays; text moves
only to documents' own rows. Phrases are told apart by 64 bits of hash (those of a trigger
also by 48 bits of its hash), windows of a spread trigger by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.bytesio import U64, ids_of, mix, prefix_hash, range_hash, slices, tidy
from pagemill.llm.pfp import repeated
from pagemill.llm.spark import batch, cut, joined, part_count, runs, table
from pagemill.llm.winnow import phrases

_A = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("key", pa.binary()), ("content", pa.binary()), ("doc", pa.binary()), ("lo", pa.binary()), ("len", pa.binary()), ("local", pa.binary())])
_B = pa.schema([("block", pa.int64()), ("doc", pa.binary()), ("lo", pa.binary()), ("len", pa.binary()), ("kind", pa.binary()), ("local", pa.binary())])
_C = pa.schema([("doc_id", pa.int64()), ("repeats", pa.binary()), ("border", pa.binary())])
_D = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("lo", pa.int64()), ("hot", pa.bool_()), ("bytes", pa.binary())])
_E = pa.schema([("doc_id", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
_SPAN = np.dtype([("lo", "<u4"), ("n", "<u4")])
_BORDER = np.dtype([("lo", "<u4"), ("n", "<u2"), ("hot", "<u2")])
_LOCAL = np.dtype([("doc", "<i8"), ("lo", "<u4"), ("n", "<u4")])
REPEAT, BORDER, HOT = 1, 2, 3
#: Bytes of text that are ordered together.
BLOCK = 1 << 20


def ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean", pa.string(): "string", pa.float64(): "double", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def runs_of(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of set flags."""
    edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def bases(size: int, most: int) -> Iterator[int]:
    """Where the parts of a text begin: windows that start within ``most`` bytes are ordered together, of a longer text as of several short ones."""
    yield from range(0, max(size, 1), most) if size > 2 * most else [0]


def _blocks(batches: Iterable[pa.RecordBatch], width: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(ids, bytes, offsets, base) of slices; a very long text comes in parts that overlap by all but one byte of a window."""
    for rows, data, off in slices(batches, most=most):
        ids = ids_of(rows)
        if len(ids) > 1:
            yield ids, data, off, 0
            continue
        starts = [*bases(len(data), most), len(data)]
        for a, b in zip(starts, starts[1:]):
            part = data[a : b + width - 1]
            yield ids, part, np.array([0, len(part)]), a


def _again(data: np.ndarray, off: np.ndarray, priority: np.ndarray, first: np.ndarray, last: np.ndarray, owner: np.ndarray, key: np.ndarray, width: int) -> np.ndarray:
    """Window starts of a block that stand in it earlier, by corpus order of what shares a trigger.

    Equal windows have equal triggers, so a window whose trigger the block holds once stands there once; the others'
    stretches, joined where they touch, are put in order.
    """
    out = np.zeros(len(data), bool)
    o = np.argsort(key)
    same = key[o][1:] == key[o][:-1]
    twice = np.zeros(len(key), bool)
    twice[o[1:][same]] = twice[o[:-1][same]] = True
    a, b, own = first[twice], last[twice] + width, owner[twice]
    if len(a):
        begin = np.append(True, (a[1:] > b[:-1]) | (own[1:] != own[:-1]))
        at = np.flatnonzero(begin)
        a, b, own = a[at], np.maximum.reduceat(b, at), own[at]
        size = b - a
        where = np.arange(int(size.sum())) + np.repeat(a - (np.cumsum(size) - size), size)
        out[where] = repeated(data[where], np.append(0, np.cumsum(size)), priority[own], a - off[own], width)
    return out


def _parse(parts: int, width: int, most: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for ids, data, off, base in _blocks(batches, width, most):
            block += 1
            first, last, owner, key = phrases(data, off, width)
            if not len(first):
                continue
            again = _again(data, off, np.unique(ids, return_inverse=True)[1], first, last, owner, key, width)
            fresh = np.append(0, np.cumsum(~again))
            fresh = fresh[last + 1] > fresh[first]
            first, last, owner, key = first[fresh], last[fresh], owner[fresh], key[fresh]
            content = range_hash(prefix_hash(data), first, last + width)
            part = (key >> U64(33)) % U64(parts)
            order = np.argsort(part.astype(np.int64), kind="stable")
            part = part[order]
            at = runs(part)
            ends = np.append(at[1:], len(part))
            cols = [key[order].view(np.uint16).reshape(-1, 4)[:, :3], content[order], ids[owner][order], (base + first - off[owner])[order].astype(np.uint32), (last - first + 1)[order].astype(np.uint8)]
            out = {"part": part[at].astype(np.int32).tolist(), "block": [block] * len(at), "local": [None] * len(at)} | {name: [c[i:j].tobytes() for i, j in zip(at, ends)] for name, c in zip(("key", "content", "doc", "lo", "len"), cols)}
            lo, hi = runs_of(again)
            if len(lo):
                own = np.searchsorted(off, lo, "right") - 1
                spans = np.zeros(len(lo), _LOCAL)
                spans["doc"], spans["lo"], spans["n"] = ids[own], base + lo - off[own], hi - lo
                out["part"].append(int(mix(np.array([block], U64))[0] >> U64(33)) % parts)
                out["block"].append(block)
                out["local"].append(spans.tobytes())
                for name in ("key", "content", "doc", "lo", "len"):
                    out[name].append(b"")
            yield batch(out, _A)

    return run


def _meet(hot: int):
    """All phrases of a trigger: mark repeats and the first of each of several phrases."""

    def run(tbl: pa.Table) -> pa.Table:
        narrow = joined(tbl, "key", np.uint16).reshape(-1, 3)  # 48 bits tell triggers of a part apart; a chance meeting is resolved by suffix order
        wide = np.zeros((len(narrow), 4), np.uint16)
        wide[:, :3] = narrow
        key = wide.view(U64).reshape(-1)
        content, doc, lo, size = joined(tbl, "content", U64), joined(tbl, "doc", np.int64), joined(tbl, "lo", np.uint32), joined(tbl, "len", np.uint8)
        counts = np.array([len(x) for x in tbl.column("len").to_pylist()])
        kind = np.zeros(len(key), np.uint8)
        order = np.argsort(key, kind="stable")
        at = runs(key[order])
        many = np.diff(np.append(at, len(key))) > 1
        keep = np.repeat(many, np.diff(np.append(at, len(key))))
        shared = order[keep]
        if len(shared):
            k, c = key[shared], content[shared]
            s = shared[np.lexsort((lo[shared], doc[shared], c, k))]
            k, c, d, p = key[s], content[s], doc[s], lo[s]
            new = np.ones(len(s), bool)
            new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
            group = np.flatnonzero(new)
            lead = np.repeat(group, np.diff(np.append(group, len(s))))
            is_first = (d == d[lead]) & (p == p[lead])  # a repeated row is no earlier than itself
            kind[s[~is_first]] = REPEAT
            start = runs(k)
            distinct = np.add.reduceat(new.astype(np.int64), start)
            distinct = np.repeat(distinct, np.diff(np.append(start, len(s))))
            kind[s[is_first & (distinct > 1)]] = BORDER
            kind[s[is_first & (distinct > hot)]] = HOT
        ends = np.cumsum(counts)
        out: dict = {f.name: [] for f in _B}
        for b, i, j in zip(tbl.column("block").to_pylist(), ends - counts, ends):
            m = np.flatnonzero(kind[i:j]) + i
            if len(m):
                out["block"].append(b)
                out["local"].append(None)
                for name, x in (("doc", doc), ("lo", lo), ("len", size), ("kind", kind)):
                    out[name].append(x[m].tobytes())
        passed = tbl.filter(tbl.column("local").is_valid())
        out["block"] += passed.column("block").to_pylist()
        out["local"] += passed.column("local").to_pylist()
        for name in ("doc", "lo", "len", "kind"):
            out[name] += [b""] * passed.num_rows
        return table(out, _B)

    return run


def _by_document(tbl: pa.Table) -> pa.Table:
    """What is marked in a block, gathered per document; neighbouring repeats become one span."""
    doc, lo, size, kind = joined(tbl, "doc", np.int64), joined(tbl, "lo", np.uint32).astype(np.int64), joined(tbl, "len", np.uint8).astype(np.int64), joined(tbl, "kind", np.uint8)
    local = joined(tbl, "local", _LOCAL)
    doc, lo, size, kind = np.append(doc, local["doc"]), np.append(lo, local["lo"]), np.append(size, local["n"]), np.append(kind, np.full(len(local), REPEAT, np.uint8))
    o = np.lexsort((lo, doc))
    doc, lo, size, kind = doc[o], lo[o], size[o], kind[o]
    at = runs(doc)
    out: dict = {"doc_id": doc[at], "repeats": [], "border": []}
    for i, j in zip(at, np.append(at[1:], len(doc))):
        rep, bor = kind[i:j] == REPEAT, kind[i:j] >= BORDER
        out["repeats"].append(join_spans(lo[i:j][rep], lo[i:j][rep] + size[i:j][rep]) if rep.any() else None)
        b = np.zeros(int(bor.sum()), _BORDER)
        b["lo"], b["n"], b["hot"] = lo[i:j][bor], size[i:j][bor], kind[i:j][bor] == HOT
        out["border"].append(b.tobytes() if len(b) else None)
    return table(out, _C)


def join_spans(lo: np.ndarray, hi: np.ndarray) -> bytes:
    """Union of half-open ranges sorted by lo, packed."""
    if len(lo) > 1:
        top = np.maximum.accumulate(hi)
        new = np.append(True, lo[1:] > top[:-1])
        at = np.flatnonzero(new)
        lo, hi = lo[at], top[np.append(at[1:], len(top)) - 1]
    s = np.zeros(len(lo), _SPAN)
    s["lo"], s["n"] = lo, hi - lo
    return s.tobytes()


def _border_bytes(parts: int, width: int, most: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in slices(batches, "text"):
            ids, out = ids_of(rows), {f.name: [] for f in _D}
            for i, packed in enumerate(rows.column(rows.schema.get_field_index("border")).to_pylist()):
                whole, seg = data[off[i] : off[i + 1]], np.frombuffer(b"".join(packed), _BORDER)
                starts = [*bases(len(whole), most), len(whole)]
                for a, b in zip(starts, starts[1:]):
                    mine = seg[(seg["lo"] >= a) & (seg["lo"] < b)]
                    if not len(mine):
                        continue
                    raw = whole[a : b + width - 1]
                    first, last, _, key = phrases(raw, np.array([0, len(raw)]), width)
                    at = np.searchsorted(first, mine["lo"] - a)
                    ok = (at < len(first)) & (first[np.minimum(at, len(first) - 1)] == mine["lo"] - a) if len(first) else np.zeros(len(mine), bool)
                    h = prefix_hash(raw) if ok.any() else None
                    for s, k in zip(mine[ok], at[ok]):
                        lo, n = int(s["lo"]) - a, int(s["n"])
                        spread = range_hash(h, np.array([lo]), np.array([lo + n - 1 + width])) if s["hot"] else mix(key[k : k + 1])
                        out["part"].append(int(spread[0] >> U64(20)) % parts)
                        out["doc_id"].append(int(ids[i]))
                        out["lo"].append(a + lo)
                        out["hot"].append(bool(s["hot"]))
                        out["bytes"].append(raw[lo : lo + n - 1 + width].tobytes())
            yield batch(out, _D)

    return run


def _corpus_order(width: int):
    """Repeats among the phrases of a part, by corpus order; first occurrences of spread triggers go on."""

    def run(tbl: pa.Table) -> pa.Table:
        pieces = tbl.column("bytes").to_pylist()
        doc, lo = tbl.column("doc_id").to_numpy().astype(np.int64), tbl.column("lo").to_numpy().astype(np.int64)
        hot = tbl.column("hot").to_numpy(zero_copy_only=False).astype(bool)
        off = np.append(0, np.cumsum([len(x) for x in pieces])).astype(np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        del pieces
        again = repeated(data, off, np.unique(doc, return_inverse=True)[1], lo, width)
        b, e = runs_of(again)
        own = np.searchsorted(off, b, "right") - 1
        out = {"doc_id": doc[own], "lo": lo[own] + b - off[own], "n": e - b, "h1": np.zeros(len(b), np.int64), "h2": np.zeros(len(b), np.int64)}
        if hot.any():
            size = np.diff(off)
            up = np.repeat(hot, size) & ~again & (np.arange(len(data)) + width <= np.repeat(off[1:], size))
            w = np.flatnonzero(up)
            own = np.searchsorted(off, w, "right") - 1
            h = range_hash(prefix_hash(data), w, w + width).view(np.int64), mix(rank_free_hash(data, w, width)).view(np.int64)
            out = {name: np.append(out[name], x) for name, x in zip(_E.names, (doc[own], lo[own] + w - off[own], np.zeros(len(w), np.int64), *h))}
        return table(out, _E)

    return run


def rank_free_hash(data: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """A second window hash, independent of range_hash: 8-byte words mixed in turn."""
    acc = np.full(len(start), 0x2545F4914F6CDD1D, U64)
    for k in range(0, width, 8):
        word = np.zeros(len(start), U64)
        for b in range(k, min(k + 8, width)):
            word = word << U64(8) | data[start + b].astype(U64)
        acc = mix(acc ^ word)
    return acc


def _cut_out(width: int, keep: list[str], schema: pa.Schema, text_out: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in slices(batches, "text"):
            get = lambda name: rows.column(rows.schema.get_field_index(name)).to_pylist()  # noqa: E731, B023
            n_bytes, n_removed, n_spans, digest, left = [], [], [], [], []
            for i, (a, b, was_null) in enumerate(zip(get("repeats"), get("more"), get("_null"))):
                raw = data[off[i] : off[i + 1]]
                spans = np.frombuffer(b"".join([*(a or []), *(b or [])]), _SPAN)
                removed = runs_ = 0
                rest = raw.tobytes()
                if len(spans):
                    lo = spans["lo"].astype(np.int64)
                    hi = np.minimum(lo + spans["n"] - 1 + width, len(raw))
                    edge = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edge, np.minimum(lo, len(raw)), 1)
                    np.add.at(edge, hi, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    removed = int(gone.sum())
                    runs_ = int((gone & ~np.append(False, gone[:-1])).sum())
                    rest = raw[~gone].tobytes()
                n_bytes.append(len(raw))
                n_removed.append(removed)
                n_spans.append(runs_)
                digest.append(hashlib.sha256(rest).hexdigest())
                if text_out:
                    left.append(None if was_null else rest.decode("utf-8", "ignore"))
            cols = {name: rows.column(rows.schema.get_field_index(name)) for name in keep}
            cols |= {"n_bytes": n_bytes, "n_removed": n_removed, "n_spans": n_spans, "kept_sha256": digest} | ({"text": left} if text_out else {})
            yield batch(cols, schema)

    return run


def repeated_spans(docs: DataFrame, width: int = 100, hot: int = 1000, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(spans of whole repeated phrases, spans of single repeated windows): doc_id, packed spans of window starts."""
    parts = part_count(docs)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    met = src.mapInArrow(tidy(_parse(parts, width, block)), ddl(_A)).groupBy("part").applyInArrow(_meet(hot), ddl(_B))
    per_doc = cut(met.groupBy("block").applyInArrow(_by_document, ddl(_C)))
    border = per_doc.where("border is not null").groupBy("doc_id").agg(F.collect_list("border").alias("border"))
    ordered = cut(src.join(border, "doc_id").mapInArrow(tidy(_border_bytes(parts, width, block)), ddl(_D)).groupBy("part").applyInArrow(_corpus_order(width), ddl(_E)))
    once = ordered.where("n = 0").select("doc_id", "lo", "h1", "h2")
    least = once.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "lo")).alias("f"), F.count("*").alias("m")).where("m > 1").select("h1", "h2", "f")
    again = once.join(least, ["h1", "h2"]).where("doc_id <> f.doc_id or lo <> f.lo").select("doc_id", "lo", F.lit(1).cast("long").alias("n"))
    singles = ordered.where("n > 0").select("doc_id", "lo", "n").unionByName(again)
    return per_doc.where("repeats is not null").select("doc_id", "repeats"), singles


def dedup(docs: DataFrame, width: int = 100, hot: int = 1000, text_out: bool = False, block: int = BLOCK) -> DataFrame:
    """Cut every byte covered by a ``width``-byte string that also starts earlier.

    Earlier means a smaller doc_id, or the same document and an earlier start;
    strings are judged on the input. Null text is empty (and stays null with
    ``text_out``). A text shorter than ``width`` keeps all its bytes. doc_id is
    a key: a repeated row gets the same result as its copy, and a row without
    doc_id is returned as it is. Other columns of ``docs`` pass through
    with ``text_out`` (clashing count columns are replaced). With ``text_out``,
    a character that loses some of its bytes is dropped, so the text stays UTF-8.
    """
    whole, singles = repeated_spans(docs, width, hot, block)
    # little-endian words, as the packed spans hold them
    le = lambda c: F.concat(*[F.unhex(F.substring(F.lpad(F.hex(c), 8, "0"), 7 - 2 * k, 2)) for k in range(4)])
    one = F.concat(le("lo"), le("n"))
    spans = whole.select("doc_id", F.col("repeats").alias("a"), F.lit(None).cast("binary").alias("b")).unionByName(singles.select("doc_id", F.lit(None).cast("binary").alias("a"), one.alias("b"))).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("a").alias("repeats"), F.collect_list("b").alias("more"))
    names = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "repeats", "more", "_null", "_id")]
    src = docs.select(*names) if text_out else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    src = src.withColumn("_null", F.col("text").isNull())
    keep = [c for c in names if c != "text"] if text_out else ["doc_id"]
    from pyspark.sql.pandas.types import to_arrow_type

    kept = [pa.field(c, to_arrow_type(src.schema[c].dataType)) for c in keep]
    schema = pa.schema([*kept, ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("text", pa.string())] if text_out else [])])
    types = {f.name: src.schema[f.name].dataType.simpleString() if f.name in keep else None for f in schema}
    out = ", ".join(f"`{f.name}` {types[f.name] or ('string' if f.type == pa.string() else 'long')}" for f in schema)
    return src.join(spans, F.col("doc_id") == F.col("_id"), "left").drop("_id").mapInArrow(tidy(_cut_out(width, keep, schema, text_out)), out)


ORACLE = r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
w AS (SELECT doc_id, i, t[i + 1:i + 100] AS s FROM (SELECT doc_id, t, unnest(range(0, octet_length(t) - 99)) AS i FROM b WHERE octet_length(t) >= 100)),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM w),
r AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS fresh FROM o WHERE nth > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r),
spans AS (SELECT doc_id, k, min(i) AS lo, max(i) + 100 AS hi FROM g GROUP BY doc_id, k),
total AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
edges AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS z FROM spans
          UNION ALL SELECT b.doc_id, coalesce(max(hi), 0), octet_length(any_value(t)) FROM b LEFT JOIN spans ON b.doc_id = spans.doc_id GROUP BY b.doc_id),
kept AS (SELECT edges.doc_id, sha256(unhex(string_agg(hex(t[a + 1:z]), '' ORDER BY a))) AS kept_sha256 FROM edges JOIN b ON edges.doc_id = b.doc_id GROUP BY edges.doc_id)
SELECT b.doc_id, octet_length(t) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM b LEFT JOIN total ON b.doc_id = total.doc_id JOIN kept ON b.doc_id = kept.doc_id
"""
