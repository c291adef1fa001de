"""Operator 1: toxicity from a lexicon matched through Levenshtein automata, scored in context.

The lexicon is learnt: words whose documents are toxic far more often than
others (likelihood ratio) in a sample of labelled texts, with their log-odds as
weights. Of texts that are near copies of each other (a shared band of minima)
one counts, as the others are no evidence of their own. Terms are kept in
tries. A word is matched by walking a trie and the word's Levenshtein automaton
together, the automaton as bit vectors, one for each number of errors, so that
a branch is left as soon as the automaton is dead. Exact terms count fully, misspelled ones less; words that clean texts use
themselves are not taken for misspellings. Misspellings are looked for of every
term, unless the sample shows that what resembles it does so by chance: the
words of a single training text are as those not seen yet, and where at least
SIGHTINGS of them resemble a term and do not lean toxic, it matches exactly only.

Each hit is judged in a window of words: inside quotation marks or beside a
reporting verb it counts less, beside an address to somebody more. A logistic
model over the hits' evidence gives the score.

Errors up to a term's allowance leave a half or a third of it whole, so terms
are in tries by these parts, and a word meets only the tries of its own parts.

Fitting uses at most ``sample`` labelled documents and keeps at most
``terms`` lexicon terms; every document is scored, whole.

Defined results: null and empty texts have no hits and get the model's score
for none; rows with null ids are scored (held_out is false) and teach nothing;
without labels of both classes the score is the share of toxic labels, or 0.
"""
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, fold, held_out, labelled_texts, map_batches, release, sample_labels, tune, written
from .models import fit_logistic, sigmoid
from .neardup import _Forest, _signed

SAMPLE, TERMS, THRESHOLD, WINDOW, LEAST = 20_000, 2_000, 0.5, 8, 20.0
#: Tables made from the sample, which is bounded, have so many parts.
PARTS = 32
#: So many sightings of rare words that resemble a term can show that they do so by chance.
SIGHTINGS = 3
_STRIP = string.punctuation + "“”„«»‘’…–—"
_OPEN, _CLOSE = tuple("\"“„«‘'"), tuple("\"”“»’'")
_REPORT = frozenset("said says say wrote writes called calls quoted quotes quote reported according term word slur dit disait écrit appelé selon sagte sagt schrieb nannte laut dijo dice escribió llamó según".split())
_ADDRESS = frozenset("you your you're youre yourself u ur tu toi vous ton votre es du dich dir dein ihr euch eres te ti usted vosotros".split())


def allowance(length: int) -> int:
    """Errors that a term of this length may have."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Trie:
    """Terms as a trie that words are matched with by their Levenshtein automaton."""

    def __init__(self, terms):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for term in terms:
            at = 0
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.term)
                    self.children.append({})
                    self.term.append(None)
                at = self.children[at][c]
            self.term[at] = term

    def near(self, word: str) -> list[tuple[str, int]]:
        """Terms within their allowance of the word, with the distance: automaton and trie side by side."""
        most = 2
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << (i + 1)
        accept, full = 1 << len(word), (1 << (len(word) + 1)) - 1
        found = []
        stack = [(0, tuple((1 << (j + 1)) - 1 & full for j in range(most + 1)))]
        while stack:
            node, rows = stack.pop()
            if term := self.term[node]:
                k = next((j for j, r in enumerate(rows) if r & accept), None)
                if k is not None and k <= allowance(len(term)):
                    found.append((term, k))
            for c, child in self.children[node].items():
                mask = masks.get(c, 0)
                new = [(rows[0] << 1) & mask]
                for j in range(1, most + 1):
                    new.append(((rows[j] << 1) & mask | rows[j - 1] | rows[j - 1] << 1 | new[j - 1] << 1) & full)
                if new[-1]:
                    stack.append((child, tuple(new)))
        return found


class Lexicon:
    """Terms with weights, looked up exactly or, by what errors leave whole, through small tries."""

    def __init__(self, weights: dict[str, float], spelled: frozenset | None = None, common: frozenset = frozenset()):
        """spelled: the terms of which misspellings are looked for (all, if None); common: words that are none."""
        self.weights, self.common = weights, common
        self.spelled = frozenset(weights) if spelled is None else spelled
        # k errors leave one of k + 1 parts whole: at an end, or, of three, in the middle moved by two at most
        heads: dict[tuple[int, str], list] = {}
        tails: dict[tuple[int, str], list] = {}
        middles: dict[tuple[int, int, str], list] = {}
        for term in self.spelled:
            if k := allowance(len(term)):
                part = len(term) // 2 if k == 1 else len(term) // 3
                rest = len(term) - part if k == 1 else part
                heads.setdefault((part, term[:part]), []).append(term)
                tails.setdefault((rest, term[-rest:]), []).append(term)
                if k == 2:
                    middles.setdefault((part, len(term) - 2 * part, term[part:-part]), []).append(term)
        self.heads, self.tails, self.middles = ({key: Trie(terms) for key, terms in group.items()} for group in (heads, tails, middles))
        self.head_sizes, self.tail_sizes = (sorted({key[0] for key in group}) for group in (heads, tails))
        self.spots: dict[int, set] = {}  # word length -> (place, length) of middles
        for part, n, _ in middles:
            for length in range(2 * part + n - 2, 2 * part + n + 3):
                self.spots.setdefault(length, set()).add((part, n))

    def close(self, word: str) -> list[tuple[str, int]]:
        """Terms that the word may be a misspelling of, with the distance."""
        if len(word) < 4 or len(word) > 64 or word in self.common:
            return []
        tries = [t for n in self.head_sizes if (t := self.heads.get((n, word[:n])))]
        tries += [t for n in self.tail_sizes if (t := self.tails.get((n, word[-n:])))]
        for p, n in self.spots.get(len(word), ()):
            tries += [t for d in (-2, -1, 0, 1, 2) if p + d >= 0 and (t := self.middles.get((p, n, word[p + d : p + d + n])))]
        return sorted(set().union(*[t.near(word) for t in tries])) if tries else []

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, errors) of the best term, or None."""
        if (own := self.weights.get(word)) is not None:
            return own, 0
        return max(((self.weights[t] * 0.6**k, k) for t, k in self.close(word)), default=None)


class Scanner:
    """Hits of a text, with a memo of at most about ``limit`` words already judged, none of them long."""

    def __init__(self, lexicon: Lexicon, limit: int = 200_000):
        self.lexicon, self.limit = lexicon, limit
        self.known: set[str] = set()
        self.hot: dict[str, tuple[float, int]] = {}

    def hits(self, text: str | None) -> tuple[list[tuple[int, str, float, int, float]], int]:
        """((place, word, weight, errors, context factor) of each hit, number of words)."""
        words = (text or "").lower().split()
        distinct = set(words)
        if len(self.known) > self.limit:
            self.known, self.hot = set(), {}
        for raw in distinct - self.known:
            if found := self.lexicon.match(raw.strip(_STRIP)):
                self.hot[raw] = found
            if len(raw) <= 64:
                self.known.add(raw)
        found = distinct & self.hot.keys()
        if not found:
            return [], len(words)
        out = []
        for i, raw in enumerate(words):
            if raw in found:
                weight, errors = self.hot[raw]
                out.append((i, raw, weight, errors, context(words, i)))
        return out, len(words)


def unquoted(words: list[str], window: int = WINDOW) -> list[str]:
    """The words that do not stand between an opening and a closing quotation mark of their window."""
    opens = np.cumsum([0] + [w.startswith(_OPEN) for w in words])
    closes = np.cumsum([0] + [w.rstrip(".,;:!?").endswith(_CLOSE) for w in words])
    if not opens[-1] or not closes[-1]:
        return words
    at = np.arange(len(words))
    inside = (opens[at + 1] > opens[np.maximum(at - window, 0)]) & (closes[np.minimum(at + window + 1, len(words))] > closes[at])
    return [w for w, quoted in zip(words, inside.tolist(), strict=True) if not quoted]


def context(words: list[str], i: int, window: int = WINDOW) -> float:
    """What a hit at place i counts for, from its neighbours: under 1 where it is quoted or reported, over 1 as an address."""
    before, after = words[max(0, i - window) : i + 1], words[i : i + window + 1]
    factor = 1.0
    if any(w.startswith(_OPEN) for w in before) and any(w.rstrip(".,;:!?").endswith(_CLOSE) for w in after):
        factor *= 0.3
    near = {w.strip(_STRIP) for w in words[max(0, i - window // 2) : i + window // 2 + 1]}
    if near & _REPORT:
        factor *= 0.7
    if near & _ADDRESS:
        factor *= 1.2
    return factor


def features(hits: list, n: int) -> list[float]:
    exact = sum(w for _, _, w, k, _ in hits if not k)
    fuzzy = sum(w for _, _, w, k, _ in hits if k)
    ruled = sum(w * f for _, _, w, _, f in hits)
    most = max((w * f for _, _, w, _, f in hits), default=0.0)
    best = max((w for _, _, w, k, _ in hits if not k), default=0.0)
    return [most, best, np.log1p(ruled), np.log1p(exact), np.log1p(fuzzy), np.log1p(100 * ruled / max(n, 20)), sum(f < 1 for *_, f in hits) / max(1, len(hits))]


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray | None, base: float):
        self.lexicon, self.weights, self.base = lexicon, weights, base

    def scores(self, texts: list, scanner: Scanner) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.base)
        x = np.array([features(*scanner.hits(t)) for t in texts])
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


def count_words(train: DataFrame) -> DataFrame:
    """word, pos, neg: toxic and other documents of the sample that use it outside quotation marks."""

    def run(batches):
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                for w in {w.strip(_STRIP) for w in unquoted((text or "").lower().split())}:
                    if 3 <= len(w) <= 64:
                        seen.setdefault(w, [0, 0])[1 - label] += 1
            if len(seen) > 200_000:
                yield flat(seen)
                seen = {}
        yield flat(seen)

    def flat(seen):
        return {"word": list(seen), "pos": [v[0] for v in seen.values()], "neg": [v[1] for v in seen.values()]}

    parts = map_batches(train.select("text", "label"), run, "word string, pos long, neg long")
    return parts.groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def independent(train: DataFrame) -> DataFrame:
    """``train`` (bounded by the sample) without the texts that share a band of minima with one of a smaller id and the same label.

    Only 28 numbers of each sampled text come to the driver.
    """
    rows = _signed(train.select(F.xxhash64("doc_id", "label").alias("doc_id"), "text"), 5, 85).filter(F.col("n") > 0).select("doc_id", "bands").toArrow()
    label = dict(train.select(F.xxhash64("doc_id", "label"), "label").toPandas().itertuples(index=False, name=None))
    ids, seen, up = rows.column("doc_id").to_pylist(), {}, _Forest()
    for i, bands in zip(ids, rows.column("bands").to_pylist(), strict=True):
        for band in bands:
            up.join(i, seen.setdefault((band, label[i]), i))
    copies = [(i,) for i in set(ids) if up.root(i) != i]
    if not copies:
        return train
    gone = train.sparkSession.createDataFrame(copies, "copy_ long")
    return train.join(F.broadcast(gone), F.xxhash64("doc_id", "label") == F.col("copy_"), "left_anti")  # at most the sample


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> Model:
    """Lexicon from folds 1 to 3, the logistic model from fold 4; fold 0 is held out."""
    tune(docs.sparkSession)
    train = labelled_texts(docs, sample_labels(labels, "toxic", sample))
    train = written(train.withColumn("fold", fold()).repartition(PARTS), "labelled")  # few texts of very many files
    train = written(independent(train).select("text", "label", "weight", "fold"), "toxic")
    sizes = {r["label"]: (r["n"], r["w"]) for r in train.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    if set(sizes) != {0, 1}:
        return Model(Lexicon({}), None, 1.0 if 1 in sizes else 0.0)
    first = train.filter(F.col("fold") != 4)
    parts = {r["label"]: r["n"] for r in first.groupBy("label").count().withColumnRenamed("count", "n").collect()}
    n_pos, n_neg = parts.get(1, 0), parts.get(0, 0)
    if not n_pos or not n_neg:
        return Model(Lexicon({}), None, sizes[1][1] / (sizes[0][1] + sizes[1][1]))
    counts = written(count_words(first).coalesce(PARTS), "words")
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    expect = (pos + neg) * (n_pos / (n_pos + n_neg))
    ratio = 2 * (pos * F.log(pos / expect) + F.when(neg > 0, neg * F.log(neg / (pos + neg - expect))).otherwise(0.0))
    weight = F.log((pos + 0.5) / (n_pos + 1.0)) - F.log((neg + 0.5) / (n_neg + 1.0))
    strong = counts.filter((pos >= 3) & (pos > expect)).select("word", "pos", ratio.alias("ratio"), weight.alias("weight"))
    top = strong.filter((F.col("ratio") >= LEAST) & (F.col("weight") >= 1.0)).orderBy(F.desc("ratio"), "word").limit(terms).collect()
    weights = {r["word"]: r["weight"] for r in top}
    lexicon = Lexicon(weights)

    def resembling(batches):  # words of the sample that look like a term
        for batch in batches:
            rows = [(w, t, p, n) for w, p, n in zip(batch["word"], batch["pos"], batch["neg"], strict=True) if w not in weights for t, _ in lexicon.close(w)]
            yield dict(zip(("word", "term", "pos", "neg"), zip(*rows, strict=True) if rows else ([], [], [], []), strict=True))

    alike = written(map_batches(counts, resembling, "word string, term string, pos long, neg long"), "alike")
    common = frozenset(r["word"] for r in alike.filter((neg >= 2) & (neg * n_pos >= pos * n_neg)).select("word").distinct().collect())
    seen = alike.filter(pos + neg == 1).groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    chance = seen.filter((pos + neg >= SIGHTINGS) & (neg * n_pos >= pos * n_neg)).select("term").collect()
    lexicon = Lexicon(weights, frozenset(weights) - {r["term"] for r in chance}, common)
    drop_written(alike)

    def feats(batches):
        scanner = Scanner(lexicon)
        for batch in batches:
            yield {"x": [features(*scanner.hits(t)) for t in batch["text"]], "y": batch["label"], "w": batch["weight"]}

    got = map_batches(train.filter(F.col("fold") == 4).select("text", "label", "weight"), feats, "x array<double>, y int, w double").toArrow().to_pydict()
    drop_written(counts)
    drop_written(train)
    y, w = np.array(got["y"], "f8"), np.array(got["w"], "f8")
    if len(set(got["y"])) < 2:
        return Model(lexicon, None, sizes[1][1] / (sizes[0][1] + sizes[1][1]))
    return Model(lexicon, fit_logistic(np.array(got["x"]), y, w / w.mean(), ridge=0.5), 0.0)


def scorer(docs: DataFrame, model: Model):
    """A function of the text column that gives the score column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        scanner = Scanner(shared.value.lexicon)
        for texts in batches:
            yield pd.Series(shared.value.scores(texts.tolist(), scanner), dtype="float64")
        del scanner
        release()

    return score


def score_table(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    tune(docs.sparkSession)
    scored = docs.select("doc_id", held_out().alias("held_out"), scorer(docs, model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def find(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """A row for each hit: doc_id, place (word number), word, weight, errors, factor (its context)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        scanner = Scanner(lexicon)
        for batch in batches:
            rows = [(i, *h) for i, t in zip(batch["doc_id"], batch["text"], strict=True) for h in scanner.hits(t)[0]]
            if rows:
                yield dict(zip(("doc_id", "place", "word", "weight", "errors", "factor"), zip(*rows, strict=True), strict=True))

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {id_type}, place int, word string, weight double, errors int, factor double")
