"""Operator 5: language identification by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of lower-cased whole texts into 2 ** bits buckets for
each language; the smoothed log-probabilities form one matrix of buckets by
languages, bounded by its parameters, which is broadcast. Scoring gathers the
rows of a text's n-grams and adds them up, in numpy, a batch at a time.

Training texts are a sample of about ``sample`` documents a language, chosen by
a hash of the id with a rate that follows from exact counts; every document is
scored.

Defined results: a null text or one without a letter is ``und`` with score 0,
as is every text when nothing could be learned; equal scores go to the first
language in alphabetical order; documents with a null language or id teach
nothing but are scored; repeated rows are scored each.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, held_out, map_batches, tune

ORDERS, BITS, SAMPLE = (1, 2, 3), 16, 4000
_CHUNK = 1 << 18  # code points hashed at a time


def buckets(text: str, bits: int, orders=ORDERS):
    """Arrays of the bucket numbers of all n-grams of a text, a chunk at a time."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    most = max(orders)
    for at in range(0, len(codes), _CHUNK):
        c = codes[at : at + _CHUNK + most - 1]
        here = min(_CHUNK, len(codes) - at)
        h = np.zeros(len(c), np.uint32)
        for n in range(1, most + 1):
            if len(c) < n:
                break
            h = (h[: len(c) - n + 1] ^ c[n - 1 :]) * np.uint32(0x9E3779B1)
            if n in orders:
                own = h[:here]
                yield (own ^ (own >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray, bits: int):
        """counts: languages by buckets."""
        self.languages, self.bits = languages, bits
        if languages:
            smooth = counts + 0.5
            table = np.log(smooth / smooth.sum(1, keepdims=True)).T.astype("f4")
            self.table = np.concatenate([table, np.zeros((1, len(languages)), "f4")])
            self.prior = np.log(documents / documents.sum())

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; n-grams of many texts are looked up and added at once."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.languages:
            return out
        group: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if not has_letter(text):
                continue
            if len(text) > _CHUNK:  # by itself, a chunk at a time
                total, n = self.prior.astype("f8"), 0
                for idx in buckets(text, self.bits):
                    total, n = total + self.table.take(idx, axis=0).sum(axis=0, dtype="f8"), n + len(idx)
                self._decide(out, [i], total[None], np.array([n]))
                continue
            group.append(i)
            size += len(text)
            if size > _CHUNK:
                self._some(texts, group, out)
                group, size = [], 0
        if group:
            self._some(texts, group, out)
        return out

    def _some(self, texts: list, group: list[int], out: list) -> None:
        coded = [np.frombuffer(texts[i].lower().encode("utf-32-le", "surrogatepass"), "<u4") for i in group]
        length = np.array([len(c) for c in coded])
        ends = np.repeat(np.cumsum(length), length)
        codes, starts = np.concatenate(coded), np.cumsum(length) - length
        total, n, h, at = np.zeros((len(group), len(self.languages))) + self.prior, np.zeros(len(group)), np.zeros(len(codes), np.uint32), np.arange(len(codes))
        for k in range(1, max(ORDERS) + 1):
            h = (h[: len(codes) - k + 1] ^ codes[k - 1 :]) * np.uint32(0x9E3779B1)
            if k in ORDERS and len(h):
                idx = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - self.bits)
                own = np.full(len(codes), len(self.table) - 1)  # the last row is zero: for what would cross into the next text
                own[: len(idx)] = np.where(at[: len(idx)] + k <= ends[: len(idx)], idx, own[: len(idx)])
                total += np.add.reduceat(self.table.take(own, axis=0), starts, axis=0, dtype="f8")
                n += np.maximum(length - k + 1, 0)
        self._decide(out, group, total, n)

    def _decide(self, out: list, group: list[int], total: np.ndarray, n: np.ndarray) -> None:
        # n-grams overlap and are far from independent: their evidence is tempered for the score
        odds = (total - total.max(1, keepdims=True)) / np.maximum(1.0, n / 64)[:, None]
        p = np.exp(odds) / np.exp(odds).sum(1, keepdims=True)
        best = total.argmax(1)
        for i, k, score in zip(group, best.tolist(), p[np.arange(len(group)), best].tolist(), strict=True):
            out[i] = (self.languages[k], score)


def fit(docs: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> Model:
    """Learn from documents with a language and outside fold 0."""
    spark = docs.sparkSession
    tune(spark)
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.empty((0, 0)), np.empty(0), bits)
    rate = F.coalesce(*[F.when(F.col("lang") == k, F.lit(sample / n)) for k, n in sizes.items()])
    chosen = usable.filter(F.crc32(F.concat(F.lit("sample"), F.col("doc_id").cast("string")).cast("binary")) < rate * float(1 << 32))

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                own = seen.setdefault(lang, np.zeros(1 << bits, "i8"))
                for idx in buckets(text or "", bits):
                    own += np.bincount(idx, minlength=1 << bits)
        for lang, own in seen.items():
            at = np.flatnonzero(own)
            yield {"lang": [lang] * len(at), "bucket": at, "n": own[at]}

    parts = map_batches(chosen.select("lang", "text").repartition(6), count, "lang string, bucket int, n long")
    got = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most languages x buckets
    counts = np.zeros((len(languages), 1 << bits))
    number = {k: i for i, k in enumerate(languages)}
    rows = [number[k] for k in got.column("lang").to_pylist()]
    counts[rows, got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return Model(languages, counts, np.array([sizes[k] for k in languages], "f8"), bits)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame(m.predict(texts.tolist()), columns=["lang_pred", "score"])

    judged = docs.select("doc_id", held_out().alias("held_out"), judge("text").alias("found"))
    return judged.select("doc_id", "held_out", "found.lang_pred", "found.score")
