"""Operator 6: token ids as flat binary files.

A data set is a folder of shards. Shard k has three files: ``k.bin``, the ids
of its documents one after the other as unsigned 16-bit (or, for vocabularies
beyond 65,536, 32-bit) little-endian integers; ``k.idx``, unsigned 64-bit
offsets of the documents in it, one more than documents; ``k.doc``, signed
64-bit document ids and then a byte for each, 1 where the id is null. Shards
follow ascending doc_id. A shard's base, the ids in all shards before it, is a
prefix sum over shards and stands in the manifest, so start = base + offset.

Each task writes files under a name of its own and reports them only when they
are complete; the manifest lists what was reported. A task that is run again
therefore never leaves half a shard behind in the data set.

Defined results: null or empty texts hold the end id alone; null ids come
first; rows with equal ids are ordered by text and each kept; an empty table
gives an empty data set; other columns are ignored.
"""
from __future__ import annotations

import json
import uuid
import zlib
from urllib.parse import urlparse

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, new_path, tune
from .tokens import library_encoder

END_ID = 2
_MANIFEST = "shard int, path string, docs long, tokens long"


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def _store(folder: str):
    """(file system, path) of a folder that is not on a mounted file system."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _put(folder: str, name: str):
    if (path := _local(folder)) is not None:
        return open(f"{path}/{name}", "wb")
    store, path = _store(folder)
    return store.open_output_stream(f"{path}/{name}")


def _get(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the folder is mounted, else read."""
    if (path := _local(folder)) is not None:
        import os

        file = f"{path}/{name}"
        return np.memmap(file, dtype, "r") if os.path.getsize(file) else np.empty(0, dtype)
    store, path = _store(folder)
    return np.frombuffer(store.open_input_file(f"{path}/{name}").read(), dtype)


def vocabulary(tokenizer: str) -> int:
    """One more than the largest id of a tokenizers file."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values(), default=-1) + 1


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, wide: bool | None = None) -> list[dict]:
    """Encode ``docs`` into the data set ``folder``; returns the manifest, a row for each shard.

    wide: ids of 32 bits; by default where the vocabulary or the end id needs them.
    """
    spark = docs.sparkSession
    tune(spark)
    if wide is None:
        wide = max(vocabulary(tokenizer), end_id + 1) > 1 << 16
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    dtype = "<u4" if wide else "<u2"

    def run(batches):
        encode, end = library_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        name, task, ids, nulls, ends = None, TaskContext.get().partitionId(), [], [], [0]
        for batch in batches:
            if name is None:
                name = f"{task:06d}-{uuid.uuid4().hex}"
                out = _put(folder, f"{name}.bin")
            codes = encode(batch["text"])
            ids_out = b"".join([part for code in codes for part in (code, end)])
            out.write(ids_out if wide else np.frombuffer(ids_out, "<u4").astype(dtype).tobytes())
            ends.extend((ends[-1] + np.cumsum([len(code) // 4 + 1 for code in codes])).tolist())
            nulls.append(np.array([i is None for i in batch["doc_id"]], "u1"))
            ids.append(np.array([i or 0 for i in batch["doc_id"]], "<i8"))
        if name is not None:
            out.close()
            with _put(folder, f"{name}.idx") as f:
                f.write(np.array(ends, "<u8").tobytes())
            with _put(folder, f"{name}.doc") as f:
                f.write(np.concatenate(ids).tobytes() + np.concatenate(nulls).tobytes())
            yield {"shard": [task], "path": [name], "docs": [len(ends) - 1], "tokens": [ends[-1]]}

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = map_batches(dealt, run, _MANIFEST, keeps=True).collect()  # a row for each shard
    base, manifest = 0, []
    for r in sorted(rows, key=lambda r: r["shard"]):
        manifest.append(r.asDict() | {"base": base, "dtype": dtype})
        base += r["tokens"]
    with _put(folder, "manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read(spark: SparkSession, folder: str, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """Documents of a data set, from its files: doc_id, start, n_tokens, ids_crc32 (and ids as unsigned 32-bit bytes)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    shards = spark.createDataFrame([(m["path"], m["base"], m["docs"], m["dtype"]) for m in manifest], "path string, base long, docs long, dtype string")

    def run(batches):
        for batch in batches:
            for path, base, docs, dtype in zip(*batch.values(), strict=True):
                ids, offsets, doc = _get(folder, f"{path}.bin", dtype), _get(folder, f"{path}.idx", "<u8").astype("int64"), _get(folder, f"{path}.doc", "u1")
                doc_id = [None if null else i for i, null in zip(np.frombuffer(doc[: 8 * docs].tobytes(), "<i8").tolist(), doc[8 * docs :].tolist(), strict=True)]
                for at in range(0, docs, 2048):
                    ends = offsets[at : min(docs, at + 2048) + 1]
                    codes = [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    yield {"doc_id": doc_id[at : at + 2048], "start": base + ends[:-1], "n_tokens": np.diff(ends), "ids_crc32": [zlib.crc32(c) for c in codes], "ids": codes}

    return map_batches(shards.repartition(max(1, len(manifest))), run, schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write all documents to a data set in the shared folder and read it back."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    return read(spark, folder, write(docs, tokenizer, folder, end_id))
