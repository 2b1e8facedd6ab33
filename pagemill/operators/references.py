"""Objects that hold references to objects: dereference chains of any length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.joins import lookup
from pagemill.plans.session import cut

#: The field of a VARIANT value that makes it a reference, and holds the id it refers to.
REFERENCE = "$.ref"


def settled(objects: DataFrame) -> DataFrame:
    """(doc_id, id, value VARIANT) -> (doc_id, id, target, hops): the object that a chain of references ends at.

    Each round every open pointer takes on the pointer of what it points at, so the length that it covers
    doubles, and what has arrived is not written again. Objects whose chain leaves the relation, or runs in a circle, have no
    target. A round in which nothing arrives and nothing is given up ends it: then all that is open points at what is open,
    and will for ever. So rounds go by the longest chain, not by the number of objects. Only ids move; values stay behind.
    """
    ref = F.try_variant_get("value", REFERENCE, "string")
    state = cut(objects.select("doc_id", "id", F.coalesce(ref, F.col("id")).alias("to"), F.when(ref.isNull(), 0).otherwise(1).cast("long").alias("hops"), ref.isNull().alias("done")))
    done, going = [state.where("done")], state.where("not done")
    n_going = going.count()
    while n_going:
        every = reduce(DataFrame.unionByName, [*done, going])
        ahead = every.select("doc_id", F.col("id").alias("to"), F.col("to").alias("_to"), F.col("hops").alias("_hops"), F.col("done").alias("_done"))
        j = lookup(going, ahead, ["doc_id", "to"]).where("_to is not null")  # what points at nothing is given up
        moved = cut(j.select("doc_id", "id", F.col("_to").alias("to"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_done").alias("done")))
        done, going = [*done, moved.where("done")], moved.where("not done")
        before, n_going = n_going, going.count()
        if n_going == before:
            break
    return reduce(DataFrame.unionByName, done).select("doc_id", "id", F.col("to").alias("target"), "hops")


def dereference(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """refs (doc_id, id, ...) with hops and the value (VARIANT) that each leads to; both null where it is absent.

    A reference to an object that holds a reference follows it, and so on. An unknown id, a null one and a circle
    are absent, never an error. ``objects`` has one row per (doc_id, id); a popular object is met in copies of its row.
    """
    ends = cut(settled(objects))
    found = cut(lookup(refs, ends, ["doc_id", "id"]))
    values = objects.where(F.try_variant_get("value", REFERENCE, "string").isNull()).select("doc_id", F.col("id").alias("target"), "value")
    return lookup(found, values, ["doc_id", "target"]).select(*refs.columns, "hops", "value")
