"""Operator 10: maximum inner products by anisotropic product quantisation, four-bit tables and exact reranking.

Vectors are cut into subspaces of DIMS components, each quantised to one of 16
centres. The centres and codes minimise the score-aware loss: the part of the
residual parallel to the vector weighs PARALLEL times the part across it, as
that part moves large inner products most. Centres are fitted on a bounded
sample; every vector is coded.

Rows of equal vectors are one candidate, which holds the ids that any query can
need of it: the k + 1 smallest, each k times at most.

Queries and vectors meet in blocks: a task gets one block of each, makes a
query's table of 16 partial products for each subspace, joins the tables of
two neighbouring subspaces into one of 256, scans a byte of codes for two
subspaces at a time, and takes each query's best vectors of the block, and all
that tie with the last of them: as many as it takes that the RERANK best of all
blocks are among them (see quota; blocks are dealt by a hash). Those are scored
exactly, in double precision, with the block's own vectors, then their ids take
their places, and the best ``k`` go on; a query's blocks are merged in the end.
So only k rows a query and block are shuffled.

Defined results: vectors that are null, zero, empty or hold null or non-finite
components take no part, nor do rows with a null id or another dimension than
the most frequent (the smallest, at a tie); equal scores go to the smaller id;
of rows that repeat an id, each is a candidate but none for its own id's
query, and the query uses the least vector; other columns are ignored.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches, tune, written

K, EVERY, DIMS, PARALLEL, SAMPLE, RERANK, BLOCK, QUERIES = 20, 20, 2, 4.0, 8192, 640, 4096, 8192


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array of doubles) of the rows that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull()
        & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    )
    return good


def fit(sample: np.ndarray, dims: int = DIMS, parallel: float = PARALLEL, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres, subspaces by 16 by dims, from a sample of vectors (zero-padded to a multiple of 2 * dims)."""
    rng = np.random.default_rng(seed)
    n, d = sample.shape
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centres = np.empty((d // dims, 16, dims))
    for s in range(d // dims):
        part = sample[:, s * dims : (s + 1) * dims]
        centres[s] = part[rng.choice(n, 16, replace=n < 16)] + rng.normal(0, 1e-6, (16, dims))
        for _ in range(rounds):  # plain k-means to start from
            near = ((part[:, None] - centres[s]) ** 2).sum(2).argmin(1)
            count = np.bincount(near, minlength=16)
            for k in range(dims):
                mean = np.bincount(near, part[:, k], 16) / np.maximum(count, 1)
                centres[s, :, k] = np.where(count > 0, mean, centres[s, :, k])
    for _ in range(3):  # score-aware: codes given the residuals of the other subspaces, then centres by least squares
        codes = encode(sample, centres, parallel)
        decoded = decode(codes, centres)
        for s in range(d // dims):
            part, u = sample[:, s * dims : (s + 1) * dims], unit[:, s * dims : (s + 1) * dims]
            other = ((sample - decoded) * unit).sum(1) - ((part - decoded[:, s * dims : (s + 1) * dims]) * u).sum(1)
            for k in range(16):
                own = codes[:, s] == k
                if own.any():
                    a = np.eye(dims) * own.sum() + (parallel - 1) * u[own].T @ u[own]
                    b = part[own].sum(0) + (parallel - 1) * (u[own] * ((part[own] * u[own]).sum(1) + other[own])[:, None]).sum(0)
                    centres[s, k] = np.linalg.solve(a, b)
            decoded[:, s * dims : (s + 1) * dims] = centres[s][codes[:, s]]
    return centres


def decode(codes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([centres[s][codes[:, s]] for s in range(len(centres))], axis=1)


def encode(x: np.ndarray, centres: np.ndarray, parallel: float = PARALLEL, rounds: int = 2) -> np.ndarray:
    """Codes that minimise |r|^2 + (parallel - 1) (r . u)^2 by coordinate descent, r the residual and u the vector's direction."""
    dims = centres.shape[2]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    parts = [x[:, s * dims : (s + 1) * dims, None].transpose(0, 2, 1) - centres[s] for s in range(len(centres))]  # n, 16, dims
    square = [(p**2).sum(2) for p in parts]
    along = [np.einsum("nkd,nd->nk", p, unit[:, s * dims : (s + 1) * dims]) for s, p in enumerate(parts)]
    codes = np.stack([q.argmin(1) for q in square], 1)
    rows = np.arange(len(x))
    total = sum(a[rows, codes[:, s]] for s, a in enumerate(along))
    for _ in range(rounds):
        for s in range(len(centres)):
            rest = total - along[s][rows, codes[:, s]]
            codes[:, s] = (square[s] + (parallel - 1) * (rest[:, None] + along[s]) ** 2).argmin(1)
            total = rest + along[s][rows, codes[:, s]]
    return codes.astype("u1")


def pad(x: np.ndarray, dims: int = DIMS) -> np.ndarray:
    short = -x.shape[1] % (2 * dims)
    return np.pad(x, ((0, 0), (0, short))) if short else x


def scan(queries: np.ndarray, packed: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Approximate products of all queries with all packed codes: one table look-up for two subspaces."""
    dims = centres.shape[2]
    q = queries.reshape(len(queries), -1, dims)
    tables = np.einsum("qsd,skd->sqk", q, centres).astype("f4")
    pairs = (tables[0::2, :, :, None] + tables[1::2, :, None, :]).reshape(len(tables) // 2, len(queries), 256)
    out = np.zeros((len(queries), len(packed)), "f4")
    for j in range(pairs.shape[0]):
        out += pairs[j].take(packed[:, j], axis=1)
    return out


def keep_ids(ids: list[int], k: int) -> list[int]:
    """Of the ids of one vector those that a query for k rows can need: the k + 1 smallest, as one may be its own, each k times at most."""
    value, count = np.unique(np.array(ids, "i8"), return_counts=True)
    return np.repeat(value[: k + 1], np.minimum(count[: k + 1], k)).tolist()


def equal_vectors(coded: DataFrame, k: int, most: int = 16_384) -> DataFrame:
    """x, code, ids of each distinct vector; rows are put together before the shuffle, so none is hot."""

    def part(batches):
        seen: dict[bytes, tuple[bytes, list[int]]] = {}
        for batch in batches:
            for i, x, c in zip(batch["vec_id"], batch["x"], batch["code"], strict=True):
                ids = seen.setdefault(x, (c, []))[1]
                ids.append(i)
                if len(ids) > 4 * k * (k + 1):
                    ids[:] = keep_ids(ids, k)
            if len(seen) >= most:
                yield flat(seen)
                seen = {}
        yield flat(seen)

    def flat(seen):
        return {"x": list(seen), "code": [c for c, _ in seen.values()], "ids": [keep_ids(i, k) if len(i) > 1 else i for _, i in seen.values()]}

    def merge(batches):
        for batch in batches:
            yield batch | {"ids": [keep_ids([i for p in parts for i in p], k) if len(parts) > 1 else parts[0] for parts in batch["ids"]]}

    schema = "x binary, code binary, ids array<long>"
    found = map_batches(coded, part, schema).groupBy("x").agg(F.min("code").alias("code"), F.collect_list("ids").alias("ids"))
    return map_batches(found.select("x", "code", "ids"), merge, schema)


def quota(blocks: int, rerank: int = RERANK) -> int:
    """So many of each of ``blocks`` blocks that the ``rerank`` best of all are among them: six standard deviations above their mean number."""
    mean = rerank / max(1, blocks)
    return math.ceil(mean + 6 * math.sqrt(mean) + 8)


def best(query_ids, queries, ids, starts, vectors, packed, centres, k: int, rerank: int):
    """(query, vector, exact score) of each query's k best in a block; vector j has ids[starts[j] : starts[j + 1]]."""
    near = scan(pad(queries), packed, centres)
    counts = np.diff(starts)
    for row, (query_id, q) in enumerate(zip(query_ids, queries, strict=True)):
        at = np.arange(len(vectors))
        if len(vectors) > rerank + 1:
            at = np.flatnonzero(near[row] >= np.partition(near[row], -rerank - 1)[-rerank - 1])
        n = counts[at]
        where = np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        own, score = ids[where], np.repeat(exact(vectors[at], q), n)
        other = own != query_id
        own, score = own[other], score[other]
        order = np.lexsort((own, -score))[:k]
        yield from zip([query_id] * len(order), own[order].tolist(), score[order].tolist(), strict=True)


def exact(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, always added in the order of components, so that equal vectors tie."""
    out = np.zeros(len(vectors))
    for d in range(vectors.shape[1]):
        out += vectors[:, d] * q[d]
    return out


def search(vectors: DataFrame, k: int = K, every: int = EVERY, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, ids divisible by ``every``."""
    spark = vectors.sparkSession
    tune(spark)
    good = usable(vectors)
    sizes = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    d = sizes[0]["d"]
    good = good.filter(F.size("x") == d)
    picked = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    x = np.array(picked.column("x").combine_chunks().flatten()).reshape(-1, d)
    shared = spark.sparkContext.broadcast(fit(pad(x)))

    def code(batches):
        centres = shared.value
        for batch in batches:
            v = np.array(batch["x"], "f8").reshape(-1, d) + 0.0  # -0.0 equals 0.0
            codes = encode(pad(v), centres)
            packed = codes[:, 0::2] << 4 | codes[:, 1::2]
            yield {"vec_id": batch["vec_id"], "x": [r.tobytes() for r in v], "code": [r.tobytes() for r in packed]}

    coded = written(map_batches(good, code, "vec_id long, x binary, code binary"), "codes")
    distinct = written(equal_vectors(coded, k), "vectors")
    wanted = coded.filter(F.col("vec_id") % every == 0)
    blocks, groups = -(-distinct.count() // BLOCK), max(1, -(-wanted.count() // QUERIES))
    most = quota(blocks, rerank)
    base = distinct.withColumn("block", F.pmod(F.xxhash64("x"), F.lit(blocks)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = wanted.groupBy("vec_id").agg(F.min("x").alias("x"))
    asked = asked.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(left, right):
        import pyarrow as pa

        def matrix(table, name, kind):
            return np.frombuffer(b"".join(table.column(name).to_pylist()), kind).reshape(table.num_rows, -1)

        found = []
        if left.num_rows and right.num_rows:
            q_ids, lists = left.column("vec_id").to_numpy(), right.column("ids").combine_chunks()
            ids, starts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            q, v, packed = matrix(left, "x", "f8"), matrix(right, "x", "f8"), matrix(right, "code", "u1")
            for at in range(0, len(q), 256):
                found += best(q_ids[at : at + 256].tolist(), q[at : at + 256], ids, starts, v, packed, shared.value, k, most)
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    pairs = asked.groupBy("block", "group").cogroup(base.groupBy("block", "group")).applyInArrow(meet, "query_id long, vec_id long, score double")
    # of the k rows a query and block only k of each task are shuffled
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
