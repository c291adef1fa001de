"""Operator 3: best-fit packing by exact-complement hashing.

Documents become token runs of at most ``capacity`` tokens. What fits with what
depends on lengths alone, and there are at most ``capacity`` different ones, so
the plan is made from the histogram of lengths: gaps are looked up among single
lengths and the sums of two and of three, and combinations that fill them
exactly are consumed as often as counts allow; what finds none goes best-fit,
longest first. The plan's size depends on ``capacity`` only, never on the
corpus, so it is made on the driver and broadcast; each piece finds its place
from its length and its rank among the pieces of that length. No piece is moved
to plan or to place it.

Defined results: a null or empty text is the end id alone; a null doc_id packs
like any other; repeated rows are packed each for itself; an empty table gives
an empty result; other columns of the input are ignored.
"""
from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches, tune, written
from .tokens import library_encoder

CAPACITY, END_ID = 2048, 0
_SPLIT = 1 << 40  # more pieces of one length than any corpus has


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than capacity, if it is cut."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences hold just these) for a histogram of lengths: the plan of exact fillings.

    Only a histogram for which best fit alone needs fewer sequences (flat ones
    with few short pieces, where fillings use up what long pieces need) gets that.
    """
    filled, alone = make_plan(counts, capacity), make_plan(counts, capacity, exact=False)
    return alone if sum(n for _, n in alone) < sum(n for _, n in filled) else filled


def make_plan(counts: dict[int, int], capacity: int, exact: bool = True) -> list[tuple[tuple[int, ...], int]]:
    """The plan of exact fillings; without ``exact``, best fit alone.

    First, single lengths that fill the gaps of those beyond half the capacity
    exactly. Then, longest first, a length goes where it fits best, or opens
    new sequences; what fills their gap exactly is looked up among single
    lengths, sums of two and sums of three, and taken as often as counts allow.
    Only new sequences look for exact fillings, so short pieces that fit beside
    long ones are not used up among themselves.
    """
    left = np.zeros(capacity + 1, "i8")
    for k, n in counts.items():
        left[k] = n
    plan: list[tuple[tuple[int, ...], int]] = []
    spaces: dict[int, list] = {}  # room left -> [lengths, sequences]
    rooms: list[int] = []
    sums = np.ones(capacity + 1, bool)  # sums of two that there may be; a sum that is gone does not come back

    def take(*lengths: int) -> None:
        need = Counter(lengths)
        times = min(int(left[k]) // m for k, m in need.items())
        if times:
            plan.append((lengths, times))
            for k, m in need.items():
                left[k] -= times * m

    def two(total: int, most: int) -> list[int]:
        """The longer members, shortest first, of the sums of two that make ``total``; very short pieces stay for gaps that need them."""
        low, high = (total + 1) // 2, min(total - 1, most)
        if low > high:
            return []
        return (low + np.flatnonzero((left[low : high + 1] > 0) & (left[total - high : total - low + 1] > 0)[::-1])).tolist()

    def fill(a: int) -> None:
        """New sequences with ``a`` as their longest, filled exactly."""
        gap = capacity - a
        if gap <= a and left[gap]:
            take(a, gap) if gap else take(a)
        for b in two(gap, a) if left[a] else ():
            if not left[a]:
                return
            take(a, b, gap - b)
        for b in range(-(-gap // 3), min(a, gap - 2) + 1):
            if not left[a]:
                return
            if left[b] and sums[gap - b]:
                pairs = two(gap - b, capacity)
                sums[gap - b] = bool(pairs)
                for c in pairs:
                    if c <= b and left[a] and left[b]:
                        take(a, b, c, gap - b - c)

    def put(room: int, lengths: tuple, n: int) -> None:
        if n:
            if room not in spaces:
                spaces[room] = []
                bisect.insort(rooms, room)
            spaces[room].append([lengths, n])

    for a in range(capacity // 2 + 1, capacity) if exact else ():
        take(a, capacity - a)
    for a in range(capacity, 0, -1):
        while left[a] and (at := bisect.bisect_left(rooms, a)) < len(rooms):
            room, n = rooms[at], int(left[a])
            lengths, bins = group = spaces[room][-1]
            each = min(room // a, n)  # best fit keeps filling the sequence it has just used
            used = min(bins, n // each)
            group[1] -= used
            left[a] -= used * each
            if not group[1]:
                spaces[room].pop()
                if not spaces[room]:
                    del spaces[room], rooms[at]
            put(room - each * a, lengths + (a,) * each, used)
        if left[a] and exact:
            fill(a)
        n, each = int(left[a]), capacity // a
        left[a] = 0
        put(capacity - each * a, (a,) * each, n // each)
        if n % each:
            put(capacity - n % each * a, (a,) * (n % each), 1)
    return plan + [(tuple(lengths), n) for room in rooms for lengths, n in spaces[room]]


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan turned round: for each length, from which rank on pieces go where."""
    taken: Counter = Counter()
    rows, base = [], 0
    for lengths, times in plan:
        at = 0
        for length, m in Counter(lengths).items():
            rows.append((length * _SPLIT + taken[length], base, m, at, length))
            taken[length] += m * times
            at += m * length
        base += times
    found = np.array(sorted(rows), "int64").reshape(-1, 5)
    return dict(zip(("key", "base", "each", "at", "length"), found.T, strict=True))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, with the rank of each among its task's pieces of its length.

    with_ids adds the ids themselves, as little-endian unsigned 32-bit integers.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids binary" * with_ids

    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        encode, seen, task = library_encoder(tokenizer), Counter(), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, code in zip(batch["doc_id"], encode(batch["text"]), strict=True):
                code += end
                for k, (start, length) in enumerate(cut_points(len(code) // 4, capacity)):
                    own = code[4 * start : 4 * (start + length)]
                    out.append((doc_id, k, start, length, zlib.crc32(own), task, seen[length], *[own] * with_ids))
                    seen[length] += 1
            if out:
                yield dict(zip(names, zip(*out, strict=True), strict=True))

    return map_batches(docs.select("doc_id", "text"), run, schema, keeps=True)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and its offset there; sequences have no gaps."""
    spark = docs.sparkSession
    tune(spark)
    cut = written(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    by_task = cut.groupBy("length", "task").agg((F.max("rank") + 1).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(places(plan_bins(counts, capacity)))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = plan.value
        at = np.searchsorted(p["key"], length.to_numpy() * _SPLIT + rank.to_numpy(), "right") - 1
        j = length.to_numpy() * _SPLIT + rank.to_numpy() - p["key"][at]
        return pd.DataFrame({"sequence_id": p["base"][at] + j // p["each"][at], "offset": p["at"][at] + j % p["each"][at] * p["length"][at]})

    placed = cut.join(bases, ["length", "task"]).withColumn("place", place("length", F.col("rank") + F.col("base")))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset"]
    return placed.select(*keep, *["ids"] * with_ids)
