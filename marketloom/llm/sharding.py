"""Minimax contiguous sharding of atomic groups: bisect the capacity, check greedily, cut there.

Groups of equal texts are laid out in order of their smallest ``doc_id``; a shard takes a contiguous
run of groups.  The smallest capacity for which ``n_shards`` runs suffice is found by search over
candidate capacities; each greedy check walks shard by shard, and every step of it is one distributed
aggregate that answers all candidates of the round at once.  Nothing but boundary offsets (a few longs)
reaches the driver.

Defined cases: a null text counts as an empty one (no bytes, CRC 0, grouped with empty texts); null
``doc_id`` sorts first; equal rows stay separate rows of one group; an empty table gives an empty result;
a group larger than an even share gets a shard of its own or shares it with few others.  Further input
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty, with_prefix_sums

CANDIDATES = 16
LOCAL_BOUNDARIES = 200_000


class Boundaries:
    """Offsets at which a group ends, with distributed floor and ceiling look-ups."""

    def __init__(self, groups: DataFrame, widest: int):
        self.ends, self.widest = groups.select("end"), widest

    def around(self, points: list[int]) -> list[tuple[int, int | None]]:
        """For each point the largest boundary at or below it (0 counts as one) and the smallest at or above it."""
        xs = sorted(set(points))  # no group is wider than `widest`, so the answers lie this close
        near = self.ends.where(F.col("end").between(xs[0] - self.widest, xs[-1] + self.widest))
        above = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in xs]), lambda x: x < F.col("end")))
        bins = {r["bin"]: r for r in near.groupBy(above.alias("bin")).agg(F.max("end").alias("top"), F.min("end").alias("low")).collect()}
        out = {}
        for i, x in enumerate(xs):  # bin i holds the boundaries in (xs[i - 1], xs[i]]
            floor = max((r["top"] for k, r in bins.items() if k <= i), default=0)
            out[x] = floor, x if floor == x else min((r["low"] for k, r in bins.items() if k > i), default=None)
        return [out[x] for x in points]

    def walk(self, capacities: list[int], total: int, n_shards: int) -> list[list[int]]:
        """Greedy fill for all capacities at once: for each, the boundary that every shard reaches."""
        at, steps = [0] * len(capacities), []
        for _ in range(n_shards):
            if any(p < total for p in at):
                at = [p for p, _ in self.around([min(total, p + c) for p, c in zip(at, capacities)])]
            steps.append(at)
        return [list(chain) for chain in zip(*steps)]

    def within(self, spans: list[tuple[int, int]]) -> list[int] | None:
        """Sorted boundaries inside the spans, or None if there are more than LOCAL_BOUNDARIES."""
        near = reduce(lambda a, b: a | b, [F.col("end").between(*span) for span in sorted(set(spans))])
        found = [r[0] for r in self.ends.where(near).limit(LOCAL_BOUNDARIES + 1).collect()]
        return sorted(found) if len(found) <= LOCAL_BOUNDARIES else None


def smallest_capacity(bounds: Boundaries, total: int, n_shards: int) -> tuple[int, list[int]]:
    """The minimax capacity and the boundaries that greedy filling reaches with it.

    Each round narrows the capacity by a factor of CANDIDATES.  Once the boundaries that any remaining
    capacity could cut at are few (LOCAL_BOUNDARIES, a fixed bound), the search ends by bisection on those.
    """
    low = max(-(-total // n_shards), bounds.widest)
    high = max(low, -(-total // n_shards) + bounds.widest)  # always enough
    while True:
        tried = sorted({low + (high - low) * i // (CANDIDATES - 1) for i in range(CANDIDATES)})
        chains = bounds.walk(tried, total, n_shards)
        first = next(i for i, chain in enumerate(chains) if chain[-1] >= total)
        if first == 0 or tried[first] - tried[first - 1] == 1:
            return tried[first], chains[first]
        low, high = tried[first - 1] + 1, tried[first]
        ends = bounds.within(list(zip(chains[first - 1], chains[first])))
        if ends is not None:
            def greedy(capacity: int) -> list[int]:
                chain, at = [], 0
                for _ in range(n_shards):
                    at = ends[bisect_right(ends, at + capacity) - 1]
                    chain.append(at)
                return chain

            while low < high:
                middle = (low + high) // 2
                low, high = (low, middle) if greedy(middle)[-1] >= total else (middle + 1, high)
            return high, greedy(high)


def cut_points(bounds: Boundaries, total: int, capacity: int, n_shards: int) -> list[int]:
    """Cuts under ``capacity``: near the even share of what is left, never so early that the rest no longer fits."""
    least, right = [], total
    for _ in range(n_shards - 1):
        right = 0 if right <= capacity else bounds.around([right - capacity])[0][1]
        least.append(right)
    cuts, at = [], 0
    for k, need in enumerate(reversed(least)):
        if at >= total:
            cuts.append(total)
            continue
        share = -(-(total - at) // (n_shards - k))
        (even, _), (_, following) = bounds.around([min(at + share, at + capacity), at + 1])
        at = max(need, even, following)
        cuts.append(at)
    return cuts


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard."""
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("_group"))
    base = stored(base, "shard-base")
    groups = base.groupBy("_group").agg(F.min("doc_id").alias("first_id"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    groups = stored(with_prefix_sums(groups, ["first_id", "_group"], {"start": "bytes", "row_start": "rows"}, "shard-order").withColumn("end", F.col("start") + F.col("bytes")), "shard-groups")  # `end` ascends: look-ups read few row groups
    sums = groups.agg(F.sum("bytes").alias("total"), F.max("bytes").alias("widest")).first()
    total, widest = sums["total"] or 0, sums["widest"] or 0
    cuts: list[int] = []
    if total:
        bounds = Boundaries(groups, widest)
        capacity, chain = smallest_capacity(bounds, total, n_shards)
        # greedy filling leaves shards empty where one group outweighs an even share: spread the rest then
        cuts = chain[:-1] if n_shards == 1 or chain[-2] < total else cut_points(bounds, total, capacity, n_shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("start") >= cut).cast("int")
    groups = groups.select("_group", "first_id", "row_start", shard.alias("shard"))
    shards = groups.groupBy("shard").agg(F.min("row_start").alias("shard_start"))  # at most n_shards rows
    placed = base.join(groups, "_group").withColumn("_one", F.lit(1).cast("long"))
    placed = with_prefix_sums(placed, ["first_id", "_group", "doc_id"], {"_row": "_one"}, "shard-rows")
    return placed.join(F.broadcast(shards), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_row") - F.col("shard_start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
