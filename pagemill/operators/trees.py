"""Numbers of a tree's nodes in reading order, by list ranking."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.scan import numbered
from pagemill.plans.session import cut

#: One entry of a list in RULERS is a ruler; a list of at most FEW entries is ranked by one task.
RULERS, FEW = 8, 1 << 18
ENTRY, AHEAD = ["doc_id", "id", "side"], ["doc_id", "to", "to_side"]


def _few_ranked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of a list of few entries, by pointer doubling in arrays."""
    import numpy as np

    batches = list(batches)
    if not batches:
        return
    t = pa.Table.from_batches(batches).to_pandas()
    t = t[t["doc_id"].notna()].reset_index(drop=True)
    places = t[ENTRY].assign(at=np.arange(len(t))).rename(columns={"id": "to", "side": "to_side"})
    at = t[AHEAD].merge(places, on=AHEAD, how="left")["at"].fillna(-1).to_numpy().astype(np.int64)
    w, ends = t["w"].to_numpy().copy(), t["to_side"].to_numpy() == 2
    lost = (at < 0) & ~ends
    for _ in range(len(t).bit_length() + 1):
        go = np.flatnonzero(~ends & ~lost)
        if not len(go):
            break
        to = at[go]
        add, end, gone, further = w[to], ends[to], lost[to], at[to]
        w[go], ends[go], lost[go], at[go] = w[go] + add, end, gone, further
    t = t.assign(w=w, to_side=np.where(ends, 2, t["to_side"]).astype(np.int32))[ends]
    yield from pa.Table.from_pandas(t, batches[0].schema, preserve_index=False).to_batches()


def _ranked(state: DataFrame, few: int = FEW, level: int = 0) -> DataFrame:
    """Entries of lists (ENTRY, AHEAD, w, counts) -> those that lead to an end (to_side 2), with w summed up to it.

    An entry in RULERS, by its hash, is a ruler. Pointer doubling takes each entry to the next ruler or the end; runs between
    rulers are short, so few rounds do, most of them with few entries, and none writes again what has arrived.
    The rulers are a list of an eighth of the length, which is ranked in the same way, and each entry adds the rank of its ruler.
    So what is moved is in proportion to the length. Circles and what leads nowhere are left out.
    """
    if state.count() <= few:
        return cut(state.repartition(1).mapInArrow(_few_ranked, state.schema))
    ruler = lambda key: F.pmod(F.xxhash64(*key, F.lit(level)), F.lit(RULERS)) == 0
    there: Column = (F.col("to_side") == 2) | ruler(AHEAD)
    arrived, going = [state.where(there)], state.where(~there)
    n_going = going.count()
    while n_going:
        every = reduce(DataFrame.unionByName, [*arrived, going]).where(~ruler(ENTRY))
        ahead = every.select("doc_id", F.col("id").alias("to"), F.col("side").alias("to_side"), F.col("to").alias("_to"), F.col("to_side").alias("_side"), F.col("w").alias("_w"))
        j = going.join(ahead, AHEAD)  # each entry follows one at most; one that leads nowhere is given up
        moved = cut(j.select(*ENTRY, F.col("_to").alias("to"), F.col("_side").alias("to_side"), (F.col("w") + F.col("_w")).alias("w"), "counts"))
        arrived, going = [*arrived, moved.where(there)], moved.where(~there)
        before, n_going = n_going, going.count()
        if n_going == before:  # all lead to entries that go on: circles
            break
    all_arrived = reduce(DataFrame.unionByName, arrived)
    rulers = _ranked(cut(all_arrived.where(ruler(ENTRY))), few, level + 1)
    rest = all_arrived.where(~ruler(ENTRY))
    if level == 0:
        rest, found = rest.where("counts"), rulers.where("counts")
    else:
        found = rulers
    rank = rulers.select("doc_id", F.col("id").alias("to"), F.col("side").alias("to_side"), F.col("w").alias("_w"))
    led = rest.where("to_side < 2").join(rank, AHEAD).select(*ENTRY, "to", F.lit(2).alias("to_side"), (F.col("w") + F.col("_w")).alias("w"), "counts")
    return cut(reduce(DataFrame.unionByName, [rest.where("to_side = 2"), led, found]))


def enumerate_nodes(nodes: DataFrame, leaves_only: bool = True, few: int = FEW) -> DataFrame:
    """(doc_id, id, parent, place) -> (doc_id, id, page): numbers from 1 in reading order.

    Children stand by (place, id) below their parent, which is null for a top node. Numbered
    are nodes without children, or all, a parent before its children. A node has two
    entries of a list, entered and left, each with the entry that follows it in a walk around the tree, and
    the list is ranked. So the form of the tree does not matter,
    and no walk or path is held anywhere. What no top node leads to (an unknown parent, a circle) has no number.
    """
    nodes = nodes.withColumn("parent", F.col("parent").cast(nodes.schema["id"].dataType))
    n = cut(numbered(nodes.select("doc_id", "id", "parent", "place"), ["doc_id", "parent"], ["place", "id"], "k").select("doc_id", "id", "parent", "k"))
    kid = n.where("k = 0 and parent is not null").select("doc_id", F.col("parent").alias("id"), F.col("id").alias("kid"))
    after = n.select(F.col("doc_id").alias("_d"), F.col("parent").alias("_p"), (F.col("k") - 1).alias("_k"), F.col("id").alias("next"))
    n = n.join(after, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("parent").eqNullSafe(F.col("_p")) & (F.col("k") == F.col("_k")), "left").join(kid, ["doc_id", "id"], "left")
    counts = F.col("kid").isNull() if leaves_only else F.lit(True)
    # side 0: entered, 1: left, 2: the end of the list
    entered = n.select("doc_id", "id", F.lit(0).alias("side"), F.coalesce("kid", "id").alias("to"), F.when(F.col("kid").isNull(), 1).otherwise(0).alias("to_side"), F.when(counts, 1).otherwise(0).cast("long").alias("w"), counts.alias("counts"))
    left = n.select("doc_id", "id", F.lit(1).alias("side"), F.coalesce("next", "parent", "id").alias("to"), F.when(F.col("next").isNotNull(), 0).when(F.col("parent").isNotNull(), 1).otherwise(2).alias("to_side"), F.lit(0).cast("long").alias("w"), F.lit(False).alias("counts"))
    state = cut(entered.unionByName(left))
    done = cut(_ranked(state, few).where("counts").select("doc_id", "id", (-F.col("w")).alias("back")))
    return numbered(done, ["doc_id"], ["back"], "page").select("doc_id", "id", (F.col("page") + 1).alias("page"))
