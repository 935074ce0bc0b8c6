"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, stash


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node reachable, for every node that has an edge.

    Alternating large-star and small-star rounds: every round joins neighbours to the
    smallest node around them, so paths halve. The edges are written each round, and a
    round's table goes when the next one is there. A node with very many neighbours is
    only aggregated (partially, before the shuffle) and joined, never gathered.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()
    now = stash(e, "edges")
    state = _fingerprint(now)
    while True:
        # large star: to every larger neighbour of u, the smallest node around u (or u itself)
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        # small star: u and its smaller neighbours to the smallest of them
        m = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(m, "hi").select(
            F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")),
                              F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo").where("hi <> lo").distinct())
        new = stash(small, "edges")
        new_state = _fingerprint(new)
        discard(now)
        now = new
        if new_state == state:
            break
        state = new_state
    members = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return members.union(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    """The same edge set gives the same figures (no overflow: 31-bit hashes are summed)."""
    h = F.xxhash64("hi", "lo")
    row = edges.agg(F.count(F.lit(1)), F.sum(F.shiftrightunsigned(h, 33)),
                    F.sum(h.bitwiseAND(F.lit((1 << 31) - 1)))).first()
    return tuple(row)
