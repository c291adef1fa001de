"""Operator 2: URL filter by rules and a character language-model ratio, in DataFrame functions only.

Rules decide the urls they fit. Those urls train two character models, of
accepted and of rejected urls: Markov models of variable order up to ORDER,
interpolated by Witten-Bell smoothing from the empty context upwards. Other
urls get the difference of their log-likelihoods under the two models, divided
by their length. A character that training has not seen after a context takes
the next shorter context's probability times what either model leaves for such
characters there (its escape mass).

A fifth of the ruled urls is kept out of the counts. Over their scores a
logistic curve is fitted, both classes with the same weight: a url is accepted
where it is likelier so.

Counts are taken over all ruled urls that are not kept out, and every counted
n-gram and context stays in the model. The distinct n-grams of the urls to be
scored are looked up in it, each order once; places get their log-ratios by the
n-gram. The most frequent n-grams, at most 2 ** BITS, are broadcast, so none
that many places have is shuffled; the others are joined by their hash.

Defined results: a null url has the verdict block, no rule, empty host and
path, score null; an empty url is scored by its end alone; a url without
``://`` is scored as it is; repeated rows are judged each; without ruled urls
of both classes every score is 0 and p_accept 0.5, so the rest is allowed.
"""
from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, written

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER, BITS, SYMBOLS = 4, 17, 1024
_PAD = "\u0002"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for a null url or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, _, below = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + below)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def with_grams(df: DataFrame, url: str, order: int) -> DataFrame:
    """A row for each character of the url with g0 to g<order>, hashes of it and the characters before it, and
    c0 to c<order>, hashes of only those before it; a row without them, if there are no characters.

    The arrays are columns of their own, so that they are made once for each url.
    """
    keep = df.columns
    shown = F.regexp_replace(F.lower(url), r"\d", "0")
    chars = F.concat(F.array(*[F.lit(_PAD)] * order), F.filter(F.split(shown, ""), lambda c: c != ""), F.array(F.lit("\u0003")))

    def name(i: Column, k: int, context: bool) -> Column:
        return F.xxhash64(F.lit(k - context), F.slice("chars_", i - k, F.lit(k + 1 - context)))

    hashes = lambda i: F.struct(*[name(i, k, c).alias(f"{'c' if c else 'g'}{k}") for k in range(order + 1) for c in (False, True)])
    at = F.transform(F.sequence(F.lit(order + 1), F.size("chars_")), hashes)
    return df.withColumn("chars_", chars).select(*keep, F.explode_outer(at).alias("h")).select(*keep, "h.*")


def train(ruled: DataFrame, order: int = ORDER) -> DataFrame:
    """order, context, gram, ratio: the log-ratio of each seen n-gram's last character after the rest, and, where
    context is true, of the escape masses after each seen context.

    ruled: url and accepted (boolean).
    """
    # a row for each place with all orders' hashes, counted before any shuffle; lower orders sum these counts
    places = with_grams(ruled.select("url", "accepted").filter(F.col("url").isNotNull()), "url", order)
    keys = [f"{x}{k}" for k in range(order + 1) for x in "gc"]
    counts = written(places.groupBy(*keys).agg(F.count_if("accepted").alias("acc"), F.count_if(~F.col("accepted")).alias("rej")), "grams")
    lower, out = None, []
    for k in range(order + 1):
        below = [F.first(f"g{k - 1}").alias("below")] if k else []
        own = counts.groupBy(f"g{k}", f"c{k}").agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej"), *below)
        seen = own.groupBy(f"c{k}").agg(*[f(x) for x in ("acc", "rej") for f in (lambda x: F.sum(x).alias(f"n_{x}"), lambda x: F.count_if(F.col(x) > 0).alias(f"t_{x}"))])
        own = own.join(seen, f"c{k}")
        if k:
            own = own.join(lower, own.below == lower.gram).drop("gram")
        base = {x: F.col(f"p_{x}") if k else F.lit(1 / SYMBOLS) for x in ("acc", "rej")}
        p = {x: F.when(F.col(f"n_{x}") == 0, base[x]).otherwise((F.col(x) + F.col(f"t_{x}") * base[x]) / (F.col(f"n_{x}") + F.col(f"t_{x}"))) for x in base}
        level = own.select(F.col(f"g{k}").alias("gram"), p["acc"].alias("p_acc"), p["rej"].alias("p_rej"))
        level = written(level, f"order{k}")
        lower = level.select("gram", "p_acc", "p_rej")
        out.append(level.select(F.lit(k).alias("order"), F.lit(False).alias("context"), "gram", (F.log("p_acc") - F.log("p_rej")).alias("ratio")))
        escape = {x: F.when(F.col(f"n_{x}") == 0, F.lit(0.0)).otherwise(F.log(F.col(f"t_{x}") / (F.col(f"n_{x}") + F.col(f"t_{x}")))) for x in base}
        out.append(seen.select(F.lit(k).alias("order"), F.lit(True).alias("context"), F.col(f"c{k}").alias("gram"), (escape["acc"] - escape["rej"]).alias("ratio")))
    every = out[0]
    for level in out[1:]:
        every = every.unionByName(level)
    return every


def look_up(grams: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, n, ratio of each distinct n-gram of the highest order: the log-ratio of its last character after the rest.

    grams: g0 to g<order>, c0 to c<order> and n, one row for each g<order>. Each
    order's distinct n-grams meet the model; where it has not seen one, the next
    shorter one's result counts, and the escape of the context, if that was seen.
    """
    lower = None
    for k in range(order + 1):
        below = [F.first(f"g{k - 1}").alias("below")] if k else []
        own = grams.groupBy(F.col(f"g{k}").alias("gram")).agg(F.sum("n").alias("n"), F.first(f"c{k}").alias("before"), *below)
        at = model.filter(F.col("order") == k)
        own = own.join(at.filter(~F.col("context")).select("gram", F.col("ratio").alias("seen")), "gram", "left")
        own = own.join(at.filter("context").select(F.col("gram").alias("before"), F.col("ratio").alias("escape")), "before", "left")
        if k:
            own = own.join(lower, "below")
        shorter = F.col("lower") if k else F.lit(0.0)
        ratio = F.coalesce("seen", F.coalesce("escape", F.lit(0.0)) + shorter)
        lower = own.select(F.col("gram").alias("below"), ratio.alias("lower"))
    return own.select("gram", "n", ratio.alias("ratio"))


def frequent(grams: DataFrame, most: int) -> DataFrame:
    """The n-grams of most places, at most ``most``: all from some eighth of an octave of n on, found from counts of these."""
    level = F.floor(F.log2("n") * 8)
    sizes = {r["level"]: r["count"] for r in grams.groupBy(level.alias("level")).count().collect()}  # a few hundred at most
    least, total = math.inf, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        least = k
    return grams.filter(level >= least) if sizes and least < math.inf else grams.limit(0)


def with_score(df: DataFrame, model: DataFrame, order: int = ORDER, bits: int = BITS) -> DataFrame:
    """Adds score, the length-normalised log-ratio of the column url; 0 for none."""
    row = unused(df, "row")
    urls = written(df.withColumn(row, F.monotonically_increasing_id()), "urls")  # numbers that stay
    top = f"g{order}"
    places = with_grams(urls.filter(F.col("url").isNotNull()).select(F.col(row).alias("row"), "url"), "url", order)
    contexts = [F.first(f"c{k}").alias(f"c{k}") for k in range(order + 1)]
    grams = written(places.groupBy(*[f"g{k}" for k in range(order, -1, -1)]).agg(F.count("*").alias("n"), *contexts), "places")
    found = written(look_up(grams, model, order), "found").withColumnRenamed("gram", top)
    hot = written(frequent(found, 1 << bits).select(top, "ratio"), "hot")
    met = places.select("row", top).join(F.broadcast(hot), top, "left")
    often = met.groupBy("row").agg(F.sum("ratio").alias("often"), F.count("*").alias("n"))
    rest = met.filter(F.col("ratio").isNull()).select("row", top).join(found.join(F.broadcast(hot.select(top)), top, "left_anti").select(top, "ratio"), top)
    seldom = rest.groupBy("row").agg(F.sum("ratio").alias("seldom"))
    sums = often.join(seldom, "row", "left").select("row", ((F.coalesce("often", F.lit(0.0)) + F.coalesce("seldom", F.lit(0.0))) / F.col("n")).alias("score"))
    sums = sums.withColumnRenamed("row", row)
    return urls.join(sums, row, "left").select(*df.columns, F.coalesce("score", F.lit(0.0)).alias("score"))


def calibrate(scored: DataFrame, steps: int = 60, bins: int = 400) -> tuple[float, float]:
    """(slope, bias) of the logistic curve of accepted over score, both classes weighing the same; (0, 0) without both.

    scored: score, accepted. Fitted on the counts and means of at most ``bins`` ranges of scores a class.
    """
    span = scored.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    if span["low"] is None:
        return 0.0, 0.0
    width = max(span["high"] - span["low"], 1e-9) / bins
    cell = F.least(F.floor((F.col("score") - span["low"]) / width), F.lit(bins - 1))
    found = scored.groupBy(cell.alias("cell"), "accepted").agg(F.count("*").alias("n"), F.avg("score").alias("x")).orderBy("cell", "accepted").collect()
    size = {y: sum(r["n"] for r in found if r["accepted"] == y) for y in (True, False)}
    if not size[True] or not size[False]:
        return 0.0, 0.0
    points = [(r["x"], 1.0 if r["accepted"] else 0.0, r["n"] / size[r["accepted"]] / 2) for r in found]
    middle = sum(w * x for x, _, w in points)
    scale = max(math.sqrt(sum(w * (x - middle) ** 2 for x, _, w in points)), 1e-9)
    points = [((x - middle) / scale, y, w) for x, y, w in points]
    a = b = 0.0
    for _ in range(steps):  # Newton, with a small ridge on the slope, as classes may be apart altogether
        ga, gb, haa, hab, hbb = 1e-3 * a, 0.0, 1e-3, 0.0, 1e-9
        for x, y, w in points:
            p = 0.5 * (1 + math.tanh(0.5 * (a * x + b)))
            ga, gb, v = ga + w * (p - y) * x, gb + w * (p - y), w * max(p * (1 - p), 1e-6)
            haa, hab, hbb = haa + v * x * x, hab + v * x, hbb + v
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        short = min(1.0, 2 / max(abs(da), abs(db), 1e-12))
        a, b = a - short * da, b - short * db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return a / scale, b - a * middle / scale


def judge(pages: DataFrame, rules=RULES, order: int = ORDER, bits: int = BITS) -> DataFrame:
    """page_id, host, path, rule, verdict, score, p_accept of every row."""
    host, path = host_path(F.col("url"))
    urls = pages.select("page_id", "url").withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("rule", rule).withColumn("ruled", ruled)
    known = urls.filter(F.col("ruled").isNotNull()).select("url", (F.col("ruled") == "allow").alias("accepted"))
    apart = F.crc32(F.col("url").cast("binary")) % 5 == 0
    both = known.filter(~apart).groupBy("accepted").count().count() == 2
    model = written(train(known.filter(~apart if both else F.lit(False)), order), "urlmodel")
    scored = written(with_score(urls, model, order, bits), "scored")
    slope, bias = calibrate(scored.filter(F.col("ruled").isNotNull() & apart).select("score", (F.col("ruled") == "allow").alias("accepted")))
    p = F.when(F.col("url").isNotNull(), 1 / (1 + F.exp(-(F.lit(slope) * F.col("score") + F.lit(bias)))))
    verdict = F.coalesce("ruled", F.when(F.col("p_accept") >= 0.5, "allow").otherwise("block"))
    scored = scored.withColumn("p_accept", p)
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("url").isNotNull(), F.col("score")).alias("score"), "p_accept")
