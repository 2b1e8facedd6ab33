"""Jaccard self-join of documents on word shingles, by T-occurrence search.

The answer is one component id per document, so no group of copies is expanded
into its pairs:

1. Documents with equal shingle sets are one class (128-bit set hash and size).
2. Shingles that no other document holds cannot count towards an overlap. Packed
   hashes meet by hash range, each block of documents sending a shingle once at
   most; a document with fewer than 3/4 of its shingles shared has no partner
   and stops here. Most do.
3. Classes that agree on a minimum over their shared shingles are compared with
   the pivot of that group (a linear number of pairs) and linked where the
   exact overlap suffices. Most true links end inside one component this way.
4. What is left is found exactly. In the order "unshared first, then rare ones, then by hash",
   two linked classes share a shingle within their prefixes (n - ceil(0.75 n) + 1
   long; rarer shingles come before commoner ones). Prefix lists that lie in one component need no more work. The others
   tie their members into cells, and in each cell a T-occurrence search
   (DivideSkip: heap merge of short lists, binary probes into long ones) runs
   between different components. A cell of more than a block is searched by pairs of
   its blocks or by its prefix lists, whichever needs fewer copies of its sets.

Shingles are told apart by 48 bits of their hash and up to 10 bits of their part (64 bits
within a block); sets by 128 bits and their size.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.bytesio import LOWER, U64, ids_of, mix, prefix_hash, range_hash, slices, tidy, words
from pagemill.llm.components import components
from pagemill.llm.spark import batch, cut, input_bytes, joined, part_count, runs, table
from pagemill.llm.suffix_dedup import ddl

SEEDS = 4
#: Bytes of text whose shingles are announced together.
BLOCK = 1 << 20
#: Lists that one step of the heap merges, and long lists that are probed together.
FAN, PROBED = 16, 64
_ODD = mix(np.arange(1, 33, dtype=U64)) | U64(1)
_MAP = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("key", pa.binary()), ("doc", pa.binary())])
_SHARED = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("key", pa.binary()), ("doc", pa.binary())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("tokens", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
ENTRY, THROUGH, DOC, ANSWER = 0, 1, 2, 3
#: A token: how common it is (6 bits, log2 of the blocks that hold it), 10 bits of its part, 48 of its hash; so ascending is rarest first.
_PLACE = U64((1 << 58) - 1)


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text: (hash, owner), sorted by owner and hash."""
    low = LOWER[data]
    start, end, owner = words(low, off)
    if not len(start):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    w = range_hash(prefix_hash(low), start, end)
    count = np.bincount(owner, minlength=len(off) - 1)
    n = len(w)
    acc = np.zeros(max(0, n - size + 1), U64)
    for k in range(size):
        acc += w[k : n - size + 1 + k] * _ODD[k]
    full = np.flatnonzero(owner[: len(acc)] == owner[size - 1 :]) if n >= size else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    first = np.cumsum(count) - count
    tiny = np.zeros(len(short), U64)
    for k in range(size - 1):
        has = count[short] > k
        tiny[has] += w[first[short][has] + k] * _ODD[k]
    tiny = mix(tiny + count[short].astype(U64) * _ODD[31])
    h = np.concatenate([mix(acc[full]), tiny])
    o = np.concatenate([owner[full], short])
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[keep], o[keep]


def narrow(h: np.ndarray, part: np.ndarray) -> np.ndarray:
    """48 bits of a shingle's hash, and its part above them."""
    return h & U64(0xFFFFFFFFFFFF) | part.astype(U64) << U64(48)


_FORMS = {1: np.uint8, 2: np.uint16, 4: np.uint32}


def tally(doc: np.ndarray, n: int) -> np.ndarray:
    """Ascending document numbers below n in the shorter of two forms, after a head of 5 bytes (form, n).

    Differences (form 1, 2 or 4: bytes each), or how often each number comes (form 11, 12 or 14).
    """
    count = np.bincount(doc, minlength=n)
    step = np.diff(doc.astype(np.int64), prepend=0)
    fit = lambda x: next(k for k in _FORMS if x.max(initial=0) < 1 << 8 * k)
    c, d = fit(count), fit(step)
    form, body = (d, step.astype(_FORMS[d])) if d * len(step) < c * n else (10 + c, count.astype(_FORMS[c]))
    return np.frombuffer(bytes([form]) + n.to_bytes(4, "little") + body.tobytes(), np.uint8)


def untally(packed: bytes) -> np.ndarray:
    form = packed[0]
    x = np.frombuffer(packed, _FORMS[form % 10], offset=5).astype(np.int64)
    return np.repeat(np.arange(len(x)), x) if form > 10 else np.cumsum(x)


def tallied(packed: bytes) -> int:
    """The n of a tally."""
    return int.from_bytes(packed[1:5], "little")


def least_shared(n):
    """The least overlap a set of n can have with a partner: ceil(0.75 n)."""
    return -(-3 * n // 4)


def linked(inter, n_a, n_b):
    return 100 * inter >= 75 * (n_a + n_b - inter)


def _shingle(parts: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for rows, data, off in slices(batches, most=BLOCK):
            block += 1
            ids = ids_of(rows)
            h, o = shingle_sets(data, off)
            n = np.bincount(o, minlength=len(ids)).astype(np.int64)
            s = np.zeros((2, len(ids)), U64)
            at = np.cumsum(n) - n
            if len(h):
                for k in range(2):
                    s[k][n > 0] = np.add.reduceat(mix(h * _ODD[10 + k]), at[n > 0])
            _, one = np.unique(s[0] ^ mix(s[1]) ^ n.astype(U64), return_index=True)  # of equal sets in a block, one goes on
            lead = np.zeros(len(ids), bool)
            lead[one] = True
            keep = lead[o]
            h, o = h[keep], o[keep]
            order = np.argsort(h, kind="stable")
            h, o = h[order], o[order].astype(np.uint32)
            start = runs(h)
            size = np.diff(np.append(start, len(h)))
            many = np.repeat(size > 1, size)
            out: dict = {f.name: [] for f in _MAP}

            def put(part, kind, key, doc):
                for name, x in (("part", part), ("block", block), ("kind", kind), ("key", key.tobytes()), ("doc", doc.tobytes())):  # noqa: B023
                    out[name].append(x)  # noqa: B023

            spread = int(mix(np.array([block], U64))[0] >> U64(33)) % parts
            put(spread, DOC, ids, np.concatenate([n, s[0].view(np.int64), s[1].view(np.int64)]))
            if many.any():
                k, d = h[many], o[many]
                by = np.lexsort((k, d))
                put(spread, THROUGH, narrow(k, ((k >> U64(33)) % U64(parts)).astype(np.int64))[by], tally(d[by], len(ids)))
            # a shingle of several documents of the block is announced once, as of a document after the last
            key = np.concatenate([h[~many], h[start[size > 1]]])
            doc = np.concatenate([o[~many], np.full(int((size > 1).sum()), len(ids), np.uint32)])
            part = ((key >> U64(33)) % U64(parts)).astype(np.int64)
            order = np.lexsort((doc, part))
            key, doc, part = narrow(key[order], part[order]), doc[order], part[order]
            at = runs(part)
            for i, j in zip(at, np.append(at[1:], len(part))):
                put(int(part[i]), ENTRY, key[i:j].view(np.uint16).reshape(-1, 4)[:, :3], tally(doc[i:j], len(ids) + 1))
            yield batch(out, _MAP)

    return run


def _share(tbl: pa.Table) -> pa.Table:
    """Of the shingles of a hash range, those that two blocks, or two documents of one block, hold."""
    kinds = tbl.column("kind").to_pylist()
    rows = [i for i, k in enumerate(kinds) if k == ENTRY]
    part = tbl.take(pa.array(rows, pa.int64()))
    docs = [untally(x) for x in part.column("doc").to_pylist()]
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    announced = np.concatenate([d == tallied(x) - 1 for d, x in zip(docs, part.column("doc").to_pylist())]) if docs else np.zeros(0, bool)
    ends = np.cumsum([len(d) for d in docs]).astype(np.int64)
    wide = np.zeros((len(doc), 4), np.uint16)
    wide[:, :3] = joined(part, "key", np.uint16).reshape(-1, 3)
    key = wide.view(U64).reshape(-1)
    order = np.argsort(key, kind="stable")
    start = runs(key[order])
    size = np.diff(np.append(start, len(key)))
    weight = np.add.reduceat(np.where(announced[order], 2, 1), start) if len(key) else size
    hit = np.zeros(len(key), bool)
    hit[order] = np.repeat(weight > 1, size)
    common = np.zeros(len(key), U64)
    common[order] = np.repeat(np.minimum(np.log2(np.maximum(weight, 1)), 31).astype(np.int64), size).astype(U64)
    rest = tbl.filter(pa.array([k != ENTRY for k in kinds], pa.bool_()))
    out: dict = {f.name: rest.column(f.name).to_pylist() for f in _SHARED}
    key |= U64((tbl.column("part")[0].as_py() & 0x3FF) if tbl.num_rows else 0) << U64(48) | common << U64(58)
    at = np.append(0, ends)
    for b, i, j in zip(part.column("block").to_pylist(), at[:-1], at[1:]):
        m = np.flatnonzero(hit[i:j] & ~announced[i:j]) + i
        if len(m):
            for name, x in (("block", b), ("kind", ENTRY), ("key", key[m].tobytes()), ("doc", tally(doc[m], int(doc[m].max()) + 1).tobytes())):
                out[name].append(x)
        m = np.flatnonzero(announced[i:j]) + i
        if len(m):  # how common the shingles are that the block knows to be shared
            for name, x in (("block", b), ("kind", ANSWER), ("key", key[m].tobytes()), ("doc", b"")):
                out[name].append(x)
    return table(out, _SHARED)


def _documents(tbl: pa.Table) -> pa.Table:
    """The documents of a block; those that may have a partner with their shared shingles and minimum keys."""
    kinds = np.array(tbl.column("kind").to_pylist())
    of = lambda kind: tbl.filter(pa.array(kinds == kind))
    numbers = lambda t: np.concatenate([untally(x) for x in t.column("doc").to_pylist()] or [np.zeros(0, np.int64)])
    head, entries, local = of(DOC), of(ENTRY), of(THROUGH)
    ids, (n, s1, s2) = joined(head, "key", np.int64), joined(head, "doc", np.int64).reshape(3, -1)
    answer, mine = np.sort(joined(of(ANSWER), "key", U64) & _PLACE), joined(local, "key", U64) & _PLACE
    full = joined(of(ANSWER), "key", U64)
    full = full[np.argsort(full & _PLACE, kind="stable")]
    mine = full[np.searchsorted(answer, mine)] if len(mine) else mine
    key, doc = np.concatenate([joined(entries, "key", U64), mine]), np.concatenate([numbers(entries), numbers(local)])
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    m = np.bincount(doc, minlength=len(ids))
    at = np.cumsum(m) - m
    tokens: list = [None] * len(ids)
    keys: list = [None] * len(ids)
    for i in np.flatnonzero((m >= least_shared(n)) & (n > 0)):
        t = key[at[i] : at[i] + m[i]]
        tokens[i] = t.view(np.int64)
        keys[i] = [int(mix(t ^ _ODD[k]).min().view(np.int64)) for k in range(SEEDS)]
    return table({"doc_id": ids, "n": n, "s1": s1, "s2": s2, "tokens": tokens, "keys": keys}, _DOCS)


class Lists:
    """Inverted lists of a group of documents: ascending document numbers by token, one after another."""

    def __init__(self, tokens: list[np.ndarray]):
        flat = np.concatenate(tokens)
        own = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        order = np.argsort(flat, kind="stable")
        at = runs(flat[order])
        size = np.diff(np.append(at, len(flat)))
        many = size > 1  # a token of one document meets nobody
        self.docs, self.token, self.at, self.size = own[order], flat[order][at[many]], at[many], size[many]
        self.span = len(tokens)

    def of(self, query: np.ndarray) -> np.ndarray:
        """Numbers of the lists of a query's tokens, the shortest first."""
        if not len(self.token):
            return np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.token, query), len(self.token) - 1)
        k = k[self.token[k] == query]
        return k[np.argsort(self.size[k], kind="stable")]

    def gather(self, lists: np.ndarray) -> np.ndarray:
        size = self.size[lists]
        total = np.cumsum(size)
        return self.docs[np.repeat(self.at[lists] - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)]


def heap_merge(lists: list[np.ndarray]) -> np.ndarray:
    """One ascending run of all ascending lists: the shortest FAN of a heap are merged and put back until one is left."""
    heap = [(len(x), k, x) for k, x in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) > 1:
        some = [heapq.heappop(heap) for _ in range(min(FAN, len(heap)))]
        merged = np.sort(np.concatenate([x for _, _, x in some]), kind="stable")  # a stable sort merges the runs it finds
        heapq.heappush(heap, (len(merged), some[0][1], merged))
    return heap[0][2] if heap else np.zeros(0, np.int64)


def divide_skip(index: Lists, query: np.ndarray, least: int, before: int) -> list[tuple[int, int]]:
    """(document, overlap) for each document < before that holds at least ``least`` of the query's tokens.

    The longest lists, ``least - 1`` at most, are set aside and a heap merges the others. A
    document seen too seldom to reach the rest is skipped; what remains probes the long lists by
    binary search, a stretch of them at a time, as long as it can still get enough.
    """
    lists = index.of(query)
    if len(lists) < least:
        return []
    aside = min(least - 1, int(least / (0.01 * np.log2(max(2, index.size[lists[-1]])) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    merged = heap_merge([index.docs[a : a + n] for a, n in zip(index.at[short].tolist(), index.size[short].tolist())])
    merged = merged[: np.searchsorted(merged, before)]
    at = runs(merged)
    count = np.diff(np.append(at, len(merged)))
    found = merged[at]
    for k in range(0, len(long) + 1, PROBED):
        enough = count >= least - (len(long) - k)
        found, count, part = found[enough], count[enough], long[k : k + PROBED]
        if not len(found) or not len(part):
            break
        keyed = np.repeat(np.arange(len(part)) * index.span, index.size[part]) + index.gather(part)
        probe = ((np.arange(len(part)) * index.span)[:, None] + found[None, :]).ravel()
        hit = keyed[np.minimum(np.searchsorted(keyed, probe), len(keyed) - 1)] == probe
        count = count + hit.reshape(len(part), -1).sum(0)
    keep = count >= least
    return list(zip(found[keep].tolist(), count[keep].tolist()))


def _search_group(ids: list[int], comps: list[int], sizes: list[int], tokens: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between different components in a group; a component pair needs one link only.

    Documents are numbered component by component, the largest first, and a query looks
    for those before its own component only; so nothing is found within one.
    """
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    many = Counter(comps)
    order = sorted(range(len(ids)), key=lambda i: (-many[comps[i]], comps[i], ids[i]))
    index = Lists([tokens[i] for i in order])
    found, start = [], 0
    for pos, i in enumerate(order):
        if comps[i] != comps[order[start]]:
            start = pos
        if not start:
            continue
        for j_pos, inter in divide_skip(index, tokens[i], least_shared(sizes[i]), start):
            j = order[j_pos]
            a, b = find(comps[i]), find(comps[j])
            if a != b and linked(inter, sizes[i], sizes[j]):
                parent[max(a, b)] = min(a, b)
                found.append((ids[i], ids[j]))
    return found


def _search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, i, j): run the search on each group."""
    group, rows = None, []

    def flush():
        found = _search_group(*(list(x) for x in zip(*rows))) if len({r[1] for r in rows}) > 1 else []  # noqa: B905
        return batch({"a": [a for a, _ in found], "b": [b for _, b in found]}, _LINK)

    for b in batches:
        *cols, lists = (b.column(b.schema.get_field_index(c)) for c in ("by_token", "cell", "i", "j", "rep", "comp", "n", "tokens"))
        flat, off = lists.values.to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy()
        for k, (*key, rep, comp, n) in enumerate(zip(*(c.to_pylist() for c in cols))):
            if key != group:
                if rows:
                    yield flush()
                group, rows = key, []
            rows.append((rep, comp, n, flat[off[k] : off[k + 1]]))
    if rows:
        yield flush()


def shared_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n, set hash (s1, s2); shared tokens and minimum keys where a partner is possible."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    parts = part_count(docs)
    return src.mapInArrow(tidy(_shingle(parts)), ddl(_MAP)).groupBy("part").applyInArrow(_share, ddl(_SHARED)).groupBy("block").applyInArrow(_documents, ddl(_DOCS))


def similar(docs: DataFrame, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Words are maximal runs of bytes other than space and \\t..\\r, with A-Z in lower
    case; a document's set is its distinct 5-word shingles, with fewer words the
    whole sequence. Two documents link where 100 * |intersection| >= 75 * |union|;
    component_id is the least doc_id reachable. Null, empty and blank texts have
    no shingles and are their own component. A repeated doc_id counts as another
    copy and gives one row each; a row without doc_id takes no part. Other columns
    are not read.
    """
    all_docs = cut(shared_documents(docs))
    classes = all_docs.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.first("tokens", True).alias("tokens"), F.first("keys", True).alias("keys"))
    classes = cut(classes)
    sets = classes.where("tokens is not null").select("rep", "n", "tokens", "keys")
    links = cut(_pivot_links(sets))
    label = components(links)
    rest = _exact_links(sets, label, block)
    if rest is not None:
        label = components(links.unionByName(rest))
    named = classes.join(label, F.col("rep") == F.col("id"), "left").select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("n").alias("cn"), F.coalesce("comp", "rep").alias("component"))
    out = all_docs.join(named, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n") == F.col("cn")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _overlap(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that link, by the exact overlap of their shared tokens."""
    sa = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    sb = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(sa, "a").join(sb, "b").withColumn("inter", F.size(F.array_intersect("ta", "tb")))
    return both.where("100 * inter >= 75 * (na + nb - inter)").select("a", "b")


def _pivot_links(sets: DataFrame) -> DataFrame:
    """Links of the sets that share a minimum key to the group's pivot: the one whose shingles are commonest.

    Copies of one text differ from each other more than from it, and its shingles stand in most of
    them. Pivots come from a partial aggregation; the join that follows reads two tables, so Spark
    may split the rows of a hot key.
    """
    common = F.aggregate("tokens", F.lit(0).cast("long"), lambda acc, x: acc + F.shiftrightunsigned(x, 58)) / F.col("n")
    posts = cut(sets.select("rep", "n", common.alias("common"), F.posexplode("keys").alias("seed", "key")))
    ends = posts.groupBy("seed", "key").agg(F.max(F.struct("common", (-F.col("rep")).alias("minus"), "n")).alias("top"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    ends = cut(ends.select("seed", "key", (-F.col("top.minus")).alias("b"), F.col("top.n").alias("m")))
    pairs = posts.join(ends, ["seed", "key"]).where("rep <> b and 4 * n >= 3 * m and 4 * m >= 3 * n").select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()
    return _overlap(pairs, sets)


def _exact_links(sets: DataFrame, label: DataFrame, block: int) -> DataFrame | None:
    """Links between different components, found through prefix lists; None if no list joins two components."""
    prefix = F.expr("slice(tokens, 1, cast(size(tokens) - ceil(0.75D * n) + 1 as int))")
    sets = sets.join(label, F.col("rep") == F.col("id"), "left").select("rep", "n", "tokens", F.coalesce("comp", "rep").alias("comp"))
    posts = sets.select("rep", "comp", F.explode(prefix).alias("token"))
    lists = posts.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("rep").alias("b")).where("lo < hi").select("token", "b")
    open_lists = cut(posts.join(lists, "token").select("token", "rep", "b"))
    edges = open_lists.where("rep <> b").select(F.col("rep").alias("a"), "b")
    if not edges.take(1):
        return None
    cell = components(edges)
    copies = open_lists.groupBy("rep").agg(F.count("*").alias("k")).withColumnRenamed("rep", "id")
    size = cell.join(copies, "id").groupBy("comp").agg(F.count("*").alias("m"), F.sum("k").alias("k"))
    ways = cut(size.select("comp", F.ceil(F.col("m") / block).cast("int").alias("nb"), (F.ceil(F.col("m") / block) > F.col("k") / F.col("m")).alias("by_token")))
    cell = cut(cell.join(ways, "comp").select(F.col("id").alias("rep"), F.col("comp").alias("cell"), "nb", "by_token"))
    # a cell is searched by pairs of its blocks or list by list (a long list by pairs of blocks), whichever needs fewer copies of its sets
    large = open_lists.join(cell.where("by_token").select("rep"), "rep").select(F.col("token").alias("cell"), "rep")
    large = large.join(large.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("nb")), "cell").withColumn("by_token", F.lit(True))
    large = cell.where("not by_token").unionByName(large).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    one = F.lit(0)
    dealt = large.select("by_token", "cell", "rep", "own", F.explode(F.sequence(one, F.col("nb") - 1)).alias("o")).select("by_token", "cell", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "rep")
    rows = dealt.join(sets, "rep").select("by_token", "cell", "i", "j", "rep", "comp", "n", "tokens")
    parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(open_lists) // (4 << 20))
    return cut(rows.repartition(parts, "by_token", "cell", "i", "j").sortWithinPartitions("by_token", "cell", "i", "j").mapInArrow(tidy(_search), ddl(_LINK)).distinct())


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT doc_id AS id, doc_id AS near FROM d UNION SELECT r.id, e.b FROM r JOIN e ON r.near = e.a),
c AS (SELECT id, min(near) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN c ON d.doc_id = c.id
"""
