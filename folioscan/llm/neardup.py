"""Operator 4: near-duplicates by MinHash with banding, links confirmed on full sets.

A document's set is its distinct shingles of SIZE words. BANDS x ROWS minima of
universal hash functions sign it (see banding). Documents whose sets are equal are one class
and only its least id goes on. Classes that agree in all rows of a band share a
bucket; 1 - (1 - s ** ROWS) ** BANDS of the pairs with Jaccard measure s do
(all but 2 in a million at the threshold). Within buckets:

1. every member is compared with the bucket's least id, first by signature
   (pairs whose signatures agree far too little stop there), then by the exact
   Jaccard measure of the full sets; links make components;
2. documents of buckets that still hold several components are joined exactly,
   across components: with every set in one order, rare shingles first, a link's
   first common shingle stands early enough in both sets that the rest can still
   reach the threshold (see _entries). Only pairs that meet at such a shingle are
   compared, the same way. So no task holds a whole bucket, sets move only for
   pairs that places do not rule out, and there is no cap that would lose a link.

Components come from alternating large-star and small-star steps.

Defined results: a null text, or one without words, has an empty set (n 0),
is linked with nothing and kept; fewer words than SIZE are one shingle; a row
with a null id is kept, without component; rows that repeat an id count as one
document with the links of all; ties do not arise (the least id leads).
"""
from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, map_batches, settle, tune, unused, written
from .components import components

#: BLOCK: members of a bucket, or sets with their entries, that go together; SHARE: a hub's pairs in one task.
SIZE, PERCENT, BLOCK, SHARE = 5, 85, 128, 512
#: Share of the pairs at the threshold that meet in no bucket, at most.
MISSED = 2e-6
#: Signatures agree in ``percent`` of minima on average; so many standard deviations below a pair is given up.
SLACK = 5.5
_FILTER_BITS = 25
#: Sets, about, and slots that tell rare shingles from common ones; they decide on work, not on results.
SAMPLE, _RARITY_BITS = 16_384, 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers = [np.ones(1, "u8"), np.ones(1, "u8")]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of the text, A-Z lower-cased: polynomials over its bytes, from prefix sums."""
    raw = np.frombuffer(text.encode("utf-8", "replace").lower(), "u1")
    if len(_powers[0]) <= len(raw):
        _powers[:] = [np.concatenate([np.ones(1, "u8"), np.cumprod(np.full(2 * len(raw) + 1024, p))]) for p in (_P, _INVERSE)]
    edge = np.diff(_SPACE[raw].view("i1"), prepend=np.int8(1), append=np.int8(1))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(begin):
        return np.empty(0, "u8")
    # byte i weighs P ** i; a word's sum is divided by P ** (its first place)
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum((raw.astype("u8") + np.uint64(1)) * _powers[0][: len(raw)])])
    return _mix((sums[end] - sums[begin]) * _powers[1][begin] + (end - begin).astype("u8"))


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = word_hashes(text) if text else np.empty(0, "u8")
    if not len(words):
        return words
    size = min(size, len(words))
    h = np.zeros(len(words) - size + 1, "u8")
    for j in range(size):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : len(words) - size + 1 + j]
    return np.unique(_mix(h + np.uint64(size)))


def banding(percent: int = PERCENT) -> tuple[int, int]:
    """(bands, rows) that miss a pair at the threshold with probability MISSED: 28 x 6 at 85, 34 x 5 at 80."""
    rows = 6 if percent >= 85 else 5
    return math.ceil(math.log(MISSED) / math.log1p(-min(percent / 100, 0.99) ** rows)), rows


def least_agreement(percent: int) -> float:
    """The share of equal minima below which a pair is given up."""
    bands, rows = banding(percent)
    s = percent / 100
    return s - SLACK * math.sqrt(s * (1 - s) / (bands * rows))


@functools.cache
def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, n, "u8") * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, "u8") * np.uint64(2)


def signature(x: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Minima of the universal hashes a x + b (high 32 bits)."""
    a, b = _hashes(math.prod(banding(percent)))
    out = np.full(len(a), np.iinfo("u8").max, "u8")
    for at in range(0, len(x), 512):
        out = np.minimum(out, (x[None, at : at + 512] * a[:, None] + b[:, None]).min(1))
    return (out >> np.uint64(32)).astype("u4")


def band_keys(signature: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """A 64-bit key for each band, the band's number included."""
    bands, rows = banding(percent)
    h = np.arange(1, bands + 1, dtype="u8")
    for column in signature.reshape(bands, rows).T:
        h = _mix(h * _P + column.astype("u8"))
    return h.view("i8")


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether the exact Jaccard measure of two sorted sets reaches percent / 100."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(long, short)
    both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, key (16 bytes that stand for the set), bands of every row."""

    def run(batches):
        for batch in batches:
            n, key, bands = [], [], []
            for text in batch["text"]:
                x = shingles(text, size)
                n.append(len(x))
                key.append(hashlib.md5(x.tobytes()).digest() if len(x) else None)
                bands.append(band_keys(signature(x, percent), percent) if len(x) else None)
            yield {"doc_id": batch["doc_id"], "n": n, "key": key, "bands": bands}

    return map_batches(docs, run, "doc_id long, n long, key binary, bands array<long>")


def _slot(node: np.ndarray) -> np.ndarray:
    return (_mix(node.astype("i8").view("u8")) >> np.uint64(64 - _FILTER_BITS)).astype("i8")


def id_filter(ids: DataFrame):
    """A broadcast bit filter of fixed size (4 MB) of the column node: what it does not have is not among them."""

    def slots(batches):
        bits = np.zeros(1 << _FILTER_BITS - 3, "u1")
        for batch in batches:
            s = _slot(np.array(batch["node"], "i8"))
            np.bitwise_or.at(bits, s >> 3, (1 << (s & 7)).astype("u1"))
        used = np.flatnonzero(bits.reshape(-1, 4096).any(1))
        yield {"page": used, "bits": [bits[4096 * p : 4096 * p + 4096].tobytes() for p in used]}

    def merge(key, pages):
        import pyarrow as pa

        bits = np.bitwise_or.reduce([np.frombuffer(b, "u1") for b in pages.column("bits").to_pylist()])
        return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    pages = map_batches(ids.repartition(8), slots, "page int, bits binary").groupBy("page").applyInArrow(merge, "page int, bits binary")
    found = np.zeros(1 << _FILTER_BITS - 3, "u1")
    for r in pages.collect():  # at most 4 MB
        found[4096 * r["page"] : 4096 * r["page"] + 4096] = np.frombuffer(r["bits"], "u1")
    return ids.sparkSession.sparkContext.broadcast(found)


def _passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    s = _slot(ids)
    return (bits[s >> 3] >> (s & 7).astype("u1") & 1).astype(bool)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not among the nodes ``gone``; rows without an id stay.

    What the bit filter rules out stays where it is; only the other rows are moved, for a join that decides.
    """
    shared, name = id_filter(gone), unused(docs, "maybe")

    @F.pandas_udf("boolean")
    def maybe(ids: pd.Series) -> pd.Series:
        return pd.Series(_passes(shared.value, ids.to_numpy("i8")), dtype=bool)

    asked = docs.withColumn(name, F.when(F.col("doc_id").isNotNull(), maybe(F.coalesce("doc_id", F.lit(0)).cast("long"))).otherwise(False))
    hit = asked.filter(name).join(gone.withColumnRenamed("node", "doc_id"), "doc_id", "left_anti")
    return asked.filter(~F.col(name)).select(*docs.columns).unionByName(hit.select(*docs.columns))


def _sets(docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """node, x (its set), signature of the documents that ``nodes`` names.

    A bit filter of fixed size keeps the texts of others from being moved. While
    it lets at most an eighth of the others pass, these sets stay, as no join
    asks for them; beyond that a join makes the choice exact.
    """
    nodes = nodes.distinct()
    loose = nodes.count() <= 1 << _FILTER_BITS - 3
    shared = id_filter(nodes)

    def run(batches):
        for batch in batches:
            ids = np.array(batch["doc_id"], "i8")
            at = np.flatnonzero(_passes(shared.value, ids))
            for part in np.array_split(at, len(at) // 64 + 1):
                xs = [shingles(batch["text"][i], size) for i in part]
                yield {"node": ids[part], "x": [x.tobytes() for x in xs], "signature": [signature(x, percent).tobytes() for x in xs]}

    own = map_batches(docs.filter(F.col("doc_id").isNotNull()), run, "node long, x binary, signature binary")
    return own if loose else own.join(nodes, "node", "left_semi")


def _beside(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b, size) with ``column`` of both as xa and xb.

    size bounds how many pairs b has in one place. A hub's pairs are dealt out by a to a task for every SHARE of them,
    and what it has goes to each.
    """
    own = sets.select("node", F.col(column).alias("x"))
    parts = F.ceil(F.col("size") / SHARE)
    hubs = pairs.groupBy("b").agg(F.max("size").alias("size")).join(own.withColumnRenamed("node", "b"), "b")
    one = hubs.select("b", F.col("x").alias("xb"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    dealt = pairs.select("a", "b", "size", F.pmod(F.xxhash64("a"), parts).alias("part"))
    return dealt.join(one, ["b", "part"]).join(own.select(F.col("node").alias("a"), F.col("x").alias("xa")), "a").drop("part")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures and then full sets agree enough; only what passes the first moves sets."""
    least = least_agreement(percent)

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([np.mean(np.frombuffer(p, "u4") == np.frombuffer(q, "u4")) >= least for p, q in zip(x, y, strict=True)], dtype=bool)

    @F.pandas_udf("boolean")
    def holds(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([linked(np.frombuffer(p, "u8"), np.frombuffer(q, "u8"), percent) for p, q in zip(x, y, strict=True)], dtype=bool)

    kept = written(_beside(pairs, sets, "signature").filter(near("xa", "xb")).select("a", "b", "size").distinct(), "near")
    settle(sets.sparkSession)
    return _beside(kept, sets, "x").filter(holds("xa", "xb")).select("a", "b")


class _Forest:
    """Union-find over few labels."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while (y := self.up.get(x, x)) != x:
            x = y
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _place(x: np.ndarray) -> np.ndarray:
    return (_mix(x) >> np.uint64(64 - _RARITY_BITS)).astype("i8")


def _rarity(sets: DataFrame):
    """A broadcast table of fixed size (2 MB): how often the sets have shingles of each slot."""

    def slots(batches):
        for batch in batches:
            s = np.sort(_place(np.frombuffer(b"".join(batch["x"]), "u8")))
            pages, at = np.unique(s >> 12, return_index=True)
            yield {"page": pages, "slots": [(s[a:b] & 4095).astype("u2").tobytes() for a, b in zip(at, [*at[1:], len(s)])]}

    def merge(key, pages):
        import pyarrow as pa

        n = np.bincount(np.concatenate([np.frombuffer(b, "u2") for b in pages.column("slots").to_pylist()]), minlength=4096)
        return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([np.minimum(n, 65535).astype("u2").tobytes()], pa.binary())})

    pages = map_batches(sets, slots, "page int, slots binary").groupBy("page").applyInArrow(merge, "page int, n binary")
    found = np.zeros(1 << _RARITY_BITS, "u2")
    for r in pages.collect():  # at most 2 MB
        found[4096 * r["page"] : 4096 * r["page"] + 4096] = np.frombuffer(r["n"], "u2")
    return sets.sparkSession.sparkContext.broadcast(found)


def _entries(sets: DataFrame, rarity, percent: int) -> DataFrame:
    """gram, node, component, n, reach: the first shingles of each set (of n) in one order of all shingles, rare ones first.

    Let a link's first common shingle have i others before it in a set of n. They share n - i shingles
    at most, so the other set has at most reach = (n - i) (100 + percent) / percent - n. It also has at
    least percent / 100 of n, and later places are left out. So linked sets meet at a shingle where
    neither's n is above the other's reach, whatever the order.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch["node"]), BLOCK):
                own = slice(at, at + BLOCK)
                grams, sizes, reaches = [], [], []
                for x in batch["x"][own]:
                    x = np.frombuffer(x, "u8")
                    reach = (len(x) - np.arange(len(x))) * (100 + percent) // percent - len(x)
                    reach = reach[100 * reach >= percent * len(x)]  # they fall
                    grams.append(x[np.argsort(rarity.value[_place(x)], kind="stable")[: len(reach)]])
                    sizes.append(len(x))
                    reaches.append(reach)
                k = [len(r) for r in reaches]
                node, component, n = (np.repeat(np.array(v, "i8"), k) for v in (batch["node"][own], batch["component"][own], sizes))
                yield {"gram": np.concatenate(grams).view("i8"), "node": node, "component": component, "n": n, "reach": np.concatenate(reaches)}

    return map_batches(sets, run, "gram long, node long, component long, n long, reach long")


def _across(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, size) across components that meet in _entries; size: the pairs of b.

    apart: node, component. Members of a component with equal places meet others as one cell.
    """
    own = sets.select("node", "x").join(apart, "node")
    every = math.ceil(apart.count() / SAMPLE)
    rarity = _rarity(own.filter(F.pmod(F.xxhash64("node"), every) == 0))
    entries = written(_entries(own, rarity, percent), "entries")
    span = entries.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least"), F.max("reach").alias("most"))
    met = written(entries.join(span.filter("low < high"), "gram").filter("reach >= least AND n <= most").select(*entries.columns), "met")
    drop_written(entries)
    cells = met.select("gram", "component", "n", "reach").distinct()
    both = cells.toDF("gram", "ca", "na", "ra").join(cells.toDF("gram", "cb", "nb", "rb"), "gram").filter("ca < cb AND na <= rb AND nb <= ra")
    for s in "ab":
        keys = ["gram", f"c{s}", f"n{s}", f"r{s}"]
        both = both.join(met.select("gram", "component", "n", "reach", "node").toDF(*keys, s), keys)
    pairs = written(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    drop_written(met)
    return pairs.join(pairs.groupBy("b").agg(F.count("*").alias("size")), "b").select("a", "b", "size")


def classes(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(_signed(docs, size, percent), "signed")
    usable = signed.filter(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    # the least id of a set leads it, with its bands; of rows that repeat one, one is left
    led = written(usable.groupBy("key").agg(F.min(F.struct("doc_id", "bands")).alias("m")).select("key", F.col("m.doc_id").alias("leader"), "m.bands"), "leaders")
    leaders = led.select("key", "leader")
    members = led.select(F.col("leader").alias("node"), F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("size")).filter("size > 1")
    crowded = written(members.join(buckets, "bucket"), "crowded")
    settle(spark)
    pairs = crowded.filter(F.col("node") != F.col("hub")).groupBy(F.col("node").alias("a"), F.col("hub").alias("b")).agg(F.max("size").alias("size"))
    sets = written(_sets(docs, crowded.select("node"), size, percent), "sets")
    settle(spark)
    links = written(_confirm(pairs, sets, percent), "links")
    settle(spark)
    found = written(components(links), "components")
    drop_written(links)
    blocks = F.ceil(F.col("size") / BLOCK)
    labelled = crowded.filter("size > 2").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).withColumn("own", F.pmod(F.xxhash64("node"), blocks))
    split = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("size").alias("size")).filter("low < high")
    split = split.select("bucket", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("own"))  # by bucket and block, so no bucket is one task
    apart = written(labelled.join(split, ["bucket", "own"]).select("node", "component").distinct(), "apart")
    more = spark.createDataFrame([], "a long, b long") if apart.isEmpty() else written(_confirm(_across(apart, sets, percent), sets, percent), "more")
    drop_written(sets)
    drop_written(crowded)
    settle(spark)
    # rows that repeat an id with another text hold their classes together
    twice = usable.select("doc_id", "key").join(leaders, "key").groupBy("doc_id").agg(F.min("leader").alias("b"), F.max("leader").alias("a")).filter("a > b").select("a", "b")
    if not more.isEmpty() or not twice.isEmpty():
        old = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = components(old.unionByName(more).unionByName(twice))
    drop_written(more)
    top = signed.select("doc_id", "n", "key").join(leaders, "key", "left").join(found.withColumnRenamed("node", "leader"), "leader", "left")
    component = F.coalesce("component", "leader", "doc_id")
    return top.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
