"""Filling fixed-capacity containers with items: cost-balanced packing of token sequences.

A text of n tokens costs linear * n + quadratic * n * n in a model with attention. Texts are taken in descending length
and each goes to the container of least cost that still has room, so that containers come out full and alike in cost.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.session import stage

#: WordPunct tokens, runs of word characters of any script and runs of other non-blank characters.
_BLANK = r"\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDPUNCT = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_BLANK}]+"


def token_count(text: Column) -> Column:
    """Number of WordPunct tokens of the whole text; 0 for NULL and blank texts."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDPUNCT)), F.lit(0))


class _Bins:
    """Open containers, by room left: a tree over the rooms holds, for each range of them, the least (cost, container)."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << max(1, capacity.bit_length())
        self.none = (float("inf"), -1)
        self.tree = [self.none] * (2 * self.size)
        self.heaps: dict[int, list[tuple[float, int]]] = {}

    def _renew(self, room: int) -> None:
        heap = self.heaps.get(room)
        at, tree = self.size + room, self.tree
        tree[at] = heap[0] if heap else self.none
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            best = a if a <= b else b
            if tree[at] == best:
                break
            tree[at] = best
            at >>= 1

    def push(self, room: int, cost: float, bin_: int) -> None:
        heapq.heappush(self.heaps.setdefault(room, []), (cost, bin_))
        self._renew(room)

    def pop(self, need: int) -> tuple[int, float, int] | None:
        """Takes out the container of least cost with room for ``need``: room, cost, container."""
        best, lo, hi, tree, at = self.none, self.size + need, 2 * self.size, self.tree, -1
        while lo < hi:
            if lo & 1:
                if tree[lo] < best:
                    best, at = tree[lo], lo
                lo += 1
            if hi & 1:
                hi -= 1
                if tree[hi] < best:
                    best, at = tree[hi], hi
            lo >>= 1
            hi >>= 1
        if at < 0:
            return None
        while at < self.size:
            at = 2 * at if tree[2 * at] == tree[at] else 2 * at + 1
        room = at - self.size
        cost, bin_ = heapq.heappop(self.heaps[room])
        self._renew(room)
        return room, cost, bin_


def pack_sizes(sizes: np.ndarray, capacity: int, linear: float, quadratic: float) -> np.ndarray:
    """The container of each item; ``sizes`` in descending order, none above ``capacity``."""
    bins, out = _Bins(capacity), np.empty(len(sizes), dtype=np.int64)
    opened = int(-(-int(sizes.sum()) // capacity)) if len(sizes) else 0
    for i in range(opened):
        bins.push(capacity, 0.0, i)
    for i, n in enumerate(sizes.tolist()):
        hit = bins.pop(n)
        if hit is None:
            hit = (capacity, 0.0, opened)
            opened += 1
        room, cost, bin_ = hit
        out[i] = bin_
        bins.push(room - n, cost + linear * n + quadratic * n * n, bin_)
    return out


def pack(
    items: DataFrame, item: str, tokens: str, plans: DataFrame, plan: str = "plan_id", capacity: str = "capacity_tokens", *, linear: float = 1.0, quadratic: float = 0.001, shard_items: int = 20_000, seed: int = 11
) -> DataFrame:
    """Containers for each plan: one row per piece of an item: ``plan``, ``item``, ``piece_no`` (from 0), ``n_pieces``,
    ``piece_tokens``, ``container`` (shard and number, unique within a plan), ``cost`` (of the piece).

    An item above the capacity is split into full pieces and a rest; no other item is split. Items without tokens take
    one empty piece, so every item is in a container of every plan; NULL counts as none. Items are dealt by their hash to
    shards of about ``shard_items`` pieces and each shard is packed by one task; a shard has the lengths of the whole,
    and wastes at most its last containers' room, so the loss is some capacity / (shard_items * mean length) and no task
    grows with the data. Repeated ids are items of their own; plans without a positive capacity, and an empty table, give no rows."""
    cap = F.col("cap")
    sized = items.select(F.col(item).alias("item"), F.coalesce(F.col(tokens), F.lit(0)).cast("int").alias("n"))
    plan_rows = plans.select(F.col(plan).alias("plan"), F.col(capacity).cast("int").alias("cap")).where("cap > 0").distinct()
    want = [r.asDict() for r in plan_rows.collect()]  # the plans: a few parameters
    if not want:
        want = [{"plan": None, "cap": 0}]
    pieces = sized.select("item", "n", F.explode(F.array(*[F.struct(F.lit(r["plan"]).cast(plan_rows.schema["plan"].dataType).alias("plan"), F.lit(r["cap"]).alias("cap")) for r in want])).alias("p")).select("item", "n", "p.*").where("cap > 0")
    count = F.greatest(F.ceil(F.col("n") / cap).cast("int"), F.lit(1))
    pieces = stage(pieces.select("plan", "cap", "item", count.alias("n_pieces"), F.posexplode(F.transform(F.sequence(F.lit(1), count), lambda i: F.least(cap, F.col("n") - (i - 1) * cap))).alias("piece_no", "piece_tokens")), "pieces")
    shards = max(1, round(pieces.groupBy("plan").count().agg(F.max("count")).first()[0] or 1) // shard_items)
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "item", "piece_no"), F.lit(shards)).cast("int"))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["piece_tokens", "item", "piece_no"], ascending=[False, True, True], kind="stable")
        n = pdf["piece_tokens"].to_numpy()
        pdf["number"] = pack_sizes(n, int(pdf["cap"].iloc[0]), linear, quadratic)
        pdf["cost"] = linear * n + quadratic * n.astype(float) ** 2
        return pdf[["plan", "item", "piece_no", "n_pieces", "piece_tokens", "shard", "number", "cost"]]

    kinds = dict(pieces.dtypes)
    packed = pieces.groupBy("plan", "shard").applyInPandas(fill, f"plan {kinds['plan']}, item {kinds['item']}, piece_no int, n_pieces int, piece_tokens int, shard int, number long, cost double")
    return packed.select("plan", "item", "piece_no", "n_pieces", "piece_tokens", F.concat_ws("-", "shard", "number").alias("container"), "cost")
