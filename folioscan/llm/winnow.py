"""Operator 9: document fingerprints by winnowing, in DataFrame functions only.

Every GRAM consecutive bytes of a text's UTF-8 make a hash, at each byte anew,
so a shared passage has the same hashes wherever it starts in either text. Of
every WINDOW consecutive hashes the smallest is selected, the rightmost of
equal ones. The order is that of the hash's upper 32 bits, packed in one long
with the place, so that a minimum of longs picks both; what is selected is then
named by its whole hash of 64 bits. Guarantee: two texts that share GRAM +
WINDOW - 1 consecutive bytes share a selected hash, and the places say where.
Likeness is the Jaccard measure of the selected hashes.

The work is linear in the text. A text is hashed in blocks, so that memory
follows BLOCK and what is selected. Texts are shuffled once: each goes to a
range of ids, where the next document is the next row. The first document of
each range goes to the range before as well, that of the first to the last.

Of an edited text only the windows that touch what has changed are looked at;
what is selected before them is the text's own selection.

Defined results: a null text is empty; an empty text selects nothing, and two
empty selections are alike (1.0); a text shorter than GRAM hashes as one, fewer
hashes than WINDOW are one window. Rows are documents in ascending order of id
and, where ids repeat, of text; the next document is the next row. A row with a
null id has no place in the order: nothing replaces its tail and near_next is
0. Other columns are ignored, empty tables give none.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRAM, WINDOW, BLOCK = 16, 32, 1 << 15
_PLACES = (1 << 32) - 1


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once and, as a lambda's variable, read without copying."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _minima(x: Column, window: int) -> Column:
    """The least of every ``window`` longs from each place on, by steps of 4 and 2; fewer towards the end."""

    def step(by: int, at: int) -> Column:
        return lambda a: F.transform(a, lambda v, i: F.least(v, *[F.get(a, i + at * k) for k in range(1, by)]))

    at = 1
    while at < window:
        by = 4 if window % (4 * at) == 0 else 2
        x, at = let(x, step(by, at)), at * by
    return x


def _block(part: Column, start: Column, window: int, gram: int) -> Column:
    """The selected longs of the windows of one block of bytes, which begins at ``start``."""
    place = lambda i: F.lit(_PLACES) - start - i
    hashed = lambda b, i: F.xxhash64(F.substring(b, i + 1, F.lit(gram))).bitwiseAND(F.lit(~_PLACES)).bitwiseOR(place(i))
    grams = let(part, lambda b: F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length(b) - gram, F.lit(0))), lambda i: hashed(b, i)))
    return F.array_distinct(let(_minima(grams, window), lambda m: F.slice(m, F.lit(1), F.greatest(F.size(m) - (window - 1), F.lit(1)))))


def _selection(data: Column, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> Column:
    """(selected longs, their hashes) of bytes, in the order of places."""
    windows = lambda b: F.octet_length(b) - (gram + window - 2)
    count = lambda b: F.when(F.octet_length(b) == 0, 0).otherwise(F.greatest(F.ceil(windows(b) / block), F.lit(1))).cast("int")
    one = lambda b, j: _block(F.substring(b, j * block + 1, F.lit(block + gram + window - 2)), (j * block).cast("long"), window, gram)
    selected = lambda b: F.array_distinct(F.flatten(F.transform(F.slice(F.sequence(F.lit(0), count(b)), F.lit(1), count(b)), lambda j: one(b, j))))
    full = lambda b: lambda x: F.xxhash64(F.substring(b, (place_of(x) + 1).cast("int"), F.lit(gram)))
    return let(data, lambda b: let(selected(b), lambda s: F.struct(s.alias("at"), F.transform(s, full(b)).alias("hash"))))


def place_of(selected: Column) -> Column:
    """The byte a selected long stands for, from 0."""
    return F.lit(_PLACES) - selected.bitwiseAND(F.lit(_PLACES))


def with_selection(df: DataFrame, text: str, out: str, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """Adds ``out``, (at, hash): the selected longs and the hashes they stand for, of the column ``text``."""
    return df.withColumn(out, _selection(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), window, gram, block))


def places(selection: Column) -> Column:
    """(hash, place) of the selection; places count bytes from 0."""
    return F.arrays_zip(selection["hash"].alias("hash"), F.transform(selection["at"], place_of).alias("place"))


def likeness(a: str, b: str) -> Column:
    """Jaccard measure of two columns of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_)


def digest(column: str) -> Column:
    """A text that stands for the selected hashes."""
    return F.sha2(F.array_join(F.col(column).cast("array<string>"), " "), 256)


def range_starts(docs: DataFrame, ranges: int) -> list[int]:
    """The first ids of at most ``ranges`` ranges of about as many rows each; a number for each range comes to the driver."""
    ids = docs.filter(F.col("doc_id").isNotNull()).select("doc_id").repartitionByRange(ranges, "doc_id")
    firsts = ids.groupBy(F.spark_partition_id().alias("range")).agg(F.min("doc_id").alias("first"))
    return sorted(r["first"] for r in firsts.collect())


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, selection, next_text, next_selection of every row; the last two are null where nothing follows."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = range_starts(docs, 4 * parts)
    bounds = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<long>")  # folded to a constant
    steps = F.array(*[F.lit(1 << k) for k in range(len(starts).bit_length() - 1, -1, -1)])

    def further(low: Column, step: Column) -> Column:
        return F.when((low + step <= len(starts)) & (F.get(bounds, low + step - 1) <= F.col("doc_id")), low + step).otherwise(low)

    docs = docs.withColumn("range", F.aggregate(steps, F.lit(0), further))  # how many ranges start at or before the id
    first = F.get(bounds, F.col("range") - 1) == F.col("doc_id")
    before = F.when(F.col("range") == 1, len(starts)).otherwise(F.col("range") - 1)
    own = F.struct(F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(4 * parts))).otherwise(F.col("range")).alias("part"), F.lit(False).alias("ghost"), F.lit(False).alias("wrap"))
    ghost = F.struct(before.cast("long").alias("part"), F.lit(True).alias("ghost"), (F.col("range") == 1).alias("wrap"))
    dealt = docs.select("doc_id", "text", F.explode(F.when(first, F.array(own, ghost)).otherwise(F.array(own))).alias("to")).select("doc_id", "text", "to.*")
    dealt = dealt.repartitionByRange(parts, "part").sortWithinPartitions("part", "wrap", "doc_id", "text")
    over = W.partitionBy("part").orderBy("wrap", "doc_id", "text")
    follows = lambda c: F.when(F.col("doc_id").isNotNull(), F.lead(c).over(over))
    seen = with_selection(dealt, "text", "selection")
    seen = seen.select("doc_id", "text", "ghost", "selection", follows("text").alias("next_text"), follows("selection").alias("next_selection"))
    return seen.filter(~F.col("ghost")).drop("ghost")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and its selection of every text."""
    return with_selection(docs.select("doc_id", "text"), "text", "selection").select("doc_id", "selection")


def edited_table(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of the text with its last quarter replaced from the next one, and their likeness."""
    docs = in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    docs = docs.withColumn("stays", F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter))
    docs = docs.withColumn("comes", F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter))
    # windows that start before ``cut`` lie in what stays; the others begin at ``tail`` at the earliest
    cut = F.greatest(F.octet_length("stays") - (WINDOW + GRAM - 2), F.lit(0))
    tail = F.greatest(cut - (WINDOW - 1), F.lit(0))
    data = F.concat(let(F.encode("stays", "UTF-8"), lambda b: F.substring(b, tail + 1, F.octet_length(b))), F.encode("comes", "UTF-8"))
    docs = docs.withColumn("changed", _selection(data)["hash"])
    kept = F.size(F.filter("selection.at", lambda x: place_of(x) < cut))
    docs = docs.withColumn("changed", F.array_distinct(F.concat(F.slice(F.col("selection.hash"), F.lit(1), kept), F.col("changed"))))
    docs = docs.withColumn("own", F.array_distinct("selection.hash")).withColumn("next", F.array_distinct("next_selection.hash"))
    return docs.select(
        "doc_id", "n_chars", F.sha2(F.concat("stays", "comes"), 256).alias("edited_sha256"), digest("own").alias("fingerprint"), digest("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), F.coalesce(likeness("own", "next"), F.lit(0.0)).alias("near_next"),
    )
