"""Operator 8: byte-level BPE through a sentencepiece model made from the ranks.

The rank file's tokens, bytes mapped to printable characters, become the pieces
of a BPE model whose scores are the negated ranks; the model is serialised here,
field by field, with identity normalisation. sentencepiece merges the pair with
the highest score, leftmost first, which is the pair of the lowest rank, so it
encodes a pre-token as the ranks ask. Decoding looks each id's bytes up.

Defined results: null and empty texts have no ids; repeated rows, ties and
nulls in other columns change nothing; an empty table gives an empty result.
"""
from __future__ import annotations

import base64
import hashlib
import struct
from array import array

import numpy as np
from pyspark.sql import DataFrame

from .common import KEPT, map_batches, tune
from .tokens import PATTERN, ChunkEncoder, byte_characters


def _field(number: int, value) -> bytes:
    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def model_proto(tokens: list[bytes]) -> bytes:
    """The serialised model; piece i + 1 is token i, piece 0 the unknown one."""
    shown = byte_characters()
    out = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for rank, token in enumerate(tokens):
        piece = "".join(shown[b] for b in token).encode()
        out.append(_field(1, _field(1, piece) + _field(2, -float(rank)) + _field(3, 1)))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + b"".join(_field(n, v) for n, v in ((40, 0), (41, (1 << 64) - 1), (42, (1 << 64) - 1), (43, (1 << 64) - 1)))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.tokens))
        self.split = regex.compile(pattern).findall
        self.shown = {b: c for b, c in enumerate(byte_characters())}
        self.decimal = [str(i) for i in range(len(self.tokens))]
        # chunks end where PATTERN always cuts; texts for another pattern are encoded one by one
        self._encoder = ChunkEncoder(self._learn) if pattern == PATTERN else self._plain

    def _pre_tokens(self, piece: str) -> list[str]:
        word = piece.removeprefix(" ")
        return [piece] if word.isascii() and word.isalpha() else self.split(piece)  # what the pattern finds whole

    def _learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._pre_tokens(c.decode()) for c in chunks]
        flat = [x if x.isascii() and x.isalpha() else x.encode("utf-8", "replace").decode("latin-1").translate(self.shown) for p in parts for x in p]
        found = self.model.encode(flat, num_threads=1) if flat else []
        sizes = np.array([len(f) for f in found], "i8")
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, parts)])]
        ids = np.fromiter((i for f in found for i in f), "u4", int(sizes.sum()))
        return ids - np.uint32(1), np.diff(ends)  # the model's ids are one higher

    def _plain(self, texts: list[str | None]) -> list[bytes]:
        return [self._learn([t.encode("utf-8", "replace")])[0].tobytes() if t else b"" for t in texts]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """ids of each text."""
        return [np.frombuffer(code, "u4").tolist() for code in self._encoder(texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process, rank file and pattern."""
    if ("codec", path, pattern) not in KEPT:
        KEPT["codec", path, pattern] = Codec(path, pattern)
    return KEPT["codec", path, pattern]


def encode_table(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text (and ids, decoded)."""
    tune(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids]

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            rows = []
            for ids in c.encode(batch["text"]):
                plain = c.decode(ids)
                shown = " ".join(map(c.decimal.__getitem__, ids)).encode()
                rows.append((len(ids), hashlib.sha256(shown).hexdigest(), hashlib.sha256(plain).hexdigest(), *([ids, plain] if with_ids else [])))
            yield {"doc_id": batch["doc_id"], **dict(zip(names, zip(*rows, strict=True), strict=True))}

    return map_batches(docs.select("doc_id", "text"), run, schema, keeps=True)
