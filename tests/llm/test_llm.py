"""The ten operators against brute force, round trips and held-out accuracy, and on awkward rows."""
import base64
import hashlib
import re
import zlib
from collections import defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import ann, bpe, langid, neardup, packing, quality, tokenbin, toxicity, urlfilter, winnow
from folioscan.llm.common import read
from folioscan.llm.components import components
from folioscan.llm.tokens import ChunkEncoder, library_encoder

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
LIBRARY, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(LIBRARY)
    t.encode_special_tokens = True
    return t


AWKWARD = [(1, "a b c d e f"), (2, None), (3, ""), (4, "a b c d e f"), (4, "a b c d e f"), (None, "x  y\n\nz "), (5, "long " * 30_000), (6, "é" * 5000), (7, " \n\t ")]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empties, repeats, long texts, and columns with names that operators use."""
    rows = [(i, t, None if k % 2 else "en", "s", k, 1.0) for k, (i, t) in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, n int, row double")


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def test_encoders_match_libraries(tokenizer):
    import random

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(5)
    bits = [" ", "  ", "\n", "\n\n", "\t", "\xa0", "a", "The", "don't", "'s", "'", "x1", "²", "12", "!", "...", "é", " foo", "日本", "<|endoftext|>", "\x1c", "_", "\r\n", "I'll ", "🙂", "\x85", ""]
    bits += ["\u3000", "\u2003", "×", "Ω", "я", "ß", "a\0", "\0", "'é", "'S", "it's,", "’s", "abcdefghijklmnopqrstuvwxyzabcdef", "ё,"]
    many = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(6000)] + ["a" * 3000, " " * 50, "\n", ""]
    got = library_encoder(LIBRARY)(many)
    assert all(np.frombuffer(g, "<u4").tolist() == w.ids for g, w in zip(got, tokenizer.encode_batch(many, add_special_tokens=False), strict=True))
    few = ChunkEncoder(library_encoder(LIBRARY).learn, limit=300, batch=1000)  # forgets all the time, takes long texts in parts
    assert few([*many, " ".join(many)]) == library_encoder(LIBRARY)([*many, " ".join(many)])
    codec = bpe.Codec(RANKS, P.PATTERN)
    assert bpe.Codec(RANKS, "(?:" + P.PATTERN + ")").encode(many) == codec.encode(many)  # one pattern that is not known to cut there
    ids = codec.encode(many)
    assert ids == [other.encode_ordinary(t) for t in many]
    assert all(codec.decode(i) == t.encode() for i, t in zip(ids, many, strict=True))


def test_new_chunks_go_to_the_library_as_they_are(monkeypatch):
    """No separators are encoded where spaces cut, in short texts; what is learnt equals each chunk alone."""
    import random

    import tokenizers

    from folioscan.llm import tokens

    seen = []

    class Counted:
        def __init__(self, own):
            self.own = own
            own.encode_special_tokens = True

        from_file = staticmethod(lambda path, make=tokenizers.Tokenizer.from_file: Counted(make(path)))

        def __getattr__(self, name):
            return getattr(self.own, name)

        def encode_batch_fast(self, texts, **more):
            seen.extend(texts)
            return self.own.encode_batch_fast(texts, **more)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    monkeypatch.setattr(tokens, "KEPT", {})
    encode = library_encoder(LIBRARY)
    plain = tokenizers.Tokenizer.from_file(LIBRARY).own
    text = "".join(f" w{k}x" for k in range(5000))
    (code,) = encode([text])
    assert np.frombuffer(code, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    seen.clear()
    r = random.Random(1)
    some = [f" {''.join(r.choices('abcdefgh', k=9))}".encode() for _ in range(3000)]
    encode.learn(some)
    assert sum(map(len, seen)) == sum(map(len, some)) and max(map(len, seen)) < 1000
    bits = [" a", "b", "'s", " 's", "12", " 7", "!", " ?", "é", " é", "日本", "\u3000x", "\u00a0y", " <|endoftext|>", "<|endoftext|>", "x\ty", "\nz", "🙂", " ", "\n\n", "\t", "\u2003"]
    for n in (1, 2, 3, 63, 64, 65, 500):
        chunks = [r.choice(bits).encode() for _ in range(n)]
        ids, counts = encode.learn(chunks)
        want = [plain.encode(c.decode(), add_special_tokens=False).ids for c in chunks]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def ids_of(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, texts, tokenizer, awkward, empty):
    for docs, source in ((read(spark, SF, "documents"), list(texts.items())), (awkward, AWKWARD)):
        got = packing.pack(docs, LIBRARY).toPandas()
        want = sorted((str(i), n, s, k, crc(ids[s : s + k])) for i, t in source for ids in [ids_of(tokenizer, t, 0)] for n, (s, k) in enumerate(packing.cut_points(len(ids), 2048)))
        ids = ["None" if x != x or x is None else str(int(x)) for x in got.doc_id]
        assert sorted(zip(ids, got.piece, got.start, got.length, got.ids_crc32, strict=True)) == want
        placed = got.sort_values(["sequence_id", "offset"])
        assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
        assert placed.groupby("sequence_id").length.sum().max() <= 2048
    assert packing.pack(empty, LIBRARY).count() == 0


def test_plan_is_complete_and_tight():
    r = np.random.default_rng(1)
    for counts in ({3: 5, 5: 5, 10: 2}, {7: 1}, {6: 9}, {}, {int(k): int(n) for k, n in zip(r.integers(1, 2049, 400), r.integers(1, 90, 400), strict=True)}):
        cap = 2048 if len(counts) > 9 else 10
        plan = packing.plan_bins(counts, cap)
        used = defaultdict(int)
        for lengths, n in plan:
            assert sum(lengths) <= cap
            for x in lengths:
                used[x] += n
        assert dict(used) == counts
        if len(counts) > 9:
            total = sum(k * n for k, n in counts.items())
            least = max(total / cap, sum(n for k, n in counts.items() if 2 * k > cap))
            assert sum(n for _, n in plan) <= 1.05 * least + 1


def test_plan_of_documents_fills_gaps_exactly(tokenizer):
    """On the documents at sf0.01: exact pairs and triples are in the plan that comes out, and it reaches the lower bound."""
    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    counts = defaultdict(int)
    for code in library_encoder(LIBRARY)(texts):
        for _, n in packing.cut_points(len(code) // 4 + 1, 2048):
            counts[n] += 1
    plan = packing.plan_bins(counts, 2048)
    assert plan == packing.make_plan(counts, 2048)
    exact = defaultdict(int)
    for lengths, n in plan:
        exact[len(lengths)] += n * (sum(lengths) == 2048)
    assert exact[1] > 100 and exact[2] > 50 and exact[3] > 100 and exact[4] > 10
    least = -(-sum(k * n for k, n in counts.items()) // 2048)
    assert sum(n for _, n in plan) == least == 481


def test_token_files(spark, texts, tokenizer, awkward, empty):
    got = tokenbin.round_trip(read(spark, SF, "documents"), LIBRARY).orderBy("doc_id").collect()
    at = 0
    for r, (i, t) in zip(got, sorted(texts.items()), strict=True):
        ids = ids_of(tokenizer, t, 2)
        assert tuple(r) == (i, at, len(ids), crc(ids))
        at += len(ids)
    assert tokenbin.vocabulary(LIBRARY) == 50_257
    from folioscan.llm.common import new_path

    for wide in (False, True):
        folder = new_path(spark, "width")
        manifest = tokenbin.write(awkward, LIBRARY, folder, wide=wide)
        assert {m["dtype"] for m in manifest} == {"<u4" if wide else "<u2"}
        assert sorted((r.start, r.ids_crc32) for r in tokenbin.read(spark, folder, manifest).collect()) == sorted((r.start, r.ids_crc32) for r in tokenbin.round_trip(awkward, LIBRARY).collect())
    rows = tokenbin.round_trip(awkward, LIBRARY).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 4, 5, 6, 7] and rows[2].n_tokens == 1
    assert tokenbin.round_trip(empty, LIBRARY).count() == 0


def test_bpe_table(spark, awkward, empty):
    got = bpe.encode_table(awkward, RANKS, P.PATTERN, with_ids=True).collect()
    assert [(r.doc_id, bytes(r.decoded).decode()) for r in got] == [(i, t or "") for i, t in AWKWARD]
    assert all(r.decoded_sha256 == hashlib.sha256(bytes(r.decoded)).hexdigest() and r.n_tokens == len(r.ids) for r in got)
    assert bpe.encode_table(empty, RANKS, P.PATTERN).count() == 0


def brute_classes(rows, size=5, percent=85):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, inverted, up = [], defaultdict(list), {}
    for k, (i, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append(frozenset(tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset())
        up[i] = i
        for x in sets[-1]:
            inverted[x].append(k)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    both = defaultdict(int)
    for found in inverted.values():
        for p in combinations(found, 2):
            both[p] += 1
    for (p, q), c in both.items():
        if 100 * c >= percent * (len(sets[p]) + len(sets[q]) - c):
            a, b = root(rows[p][0]), root(rows[q][0])
            up[max(a, b)] = min(a, b)
    return sorted((i, len(s), root(i)) for (i, _), s in zip(rows, sets, strict=True))


def test_near_duplicates(spark, texts, awkward, empty):
    got = neardup.classes(read(spark, SF, "documents")).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(tuple(r)[:3] for r in got) == brute_classes(list(texts.items()))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    own = [r for r in AWKWARD if r[0] is not None]
    odd = neardup.classes(awkward).collect()
    assert sorted(tuple(r)[:3] for r in odd if r.doc_id is not None) == brute_classes(own)
    assert [(r.component_id, r.kept) for r in odd if r.doc_id is None] == [(None, True)]
    assert neardup.classes(empty).count() == 0


def test_pipeline_drops_near_copies_from_four_fifths(spark):
    """Pairs between 0.80 and 0.85 are near copies to the stage, though not to op4."""
    import corpus_pipeline as C

    rows = []
    for pair in range(40):  # 96 shingles, 10 of them changed: 86 / 106 = 0.811
        base = [f"p{pair}w{k}" for k in range(100)]
        rows += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join([*base[:20], "x", *base[21:60], "y", *base[61:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.kept for r in neardup.classes(docs).collect())
    assert sorted(tuple(r)[:3] for r in neardup.classes(docs, percent=80).collect()) == brute_classes(rows, percent=80)
    assert sorted(r.doc_id for r in C.drop_near_duplicates(spark, docs, SF).collect()) == list(range(0, 80, 2))
    assert neardup.banding(85) == (28, 6) and all((1 - (p / 100) ** r) ** b <= neardup.MISSED for p in (80, 85) for b, r in [neardup.banding(p)])


def test_near_duplicates_in_families(spark, monkeypatch):
    """Chains and large families, where hubs fail and blocks of a bucket must meet."""
    r = np.random.default_rng(3)
    rows, words = [], [f"w{k}" for k in range(400)]
    for family in range(6):
        base = list(r.choice(words, 120))
        for _ in range(40):
            rows.append((len(rows), " ".join(base)))
            base = list(base)
            base[r.integers(120)] = f"x{len(rows)}"  # each differs from the one before, so far ones differ much
            if r.random() < 0.5:
                base[r.integers(120)] = f"y{len(rows)}"
    monkeypatch.setattr(neardup, "BLOCK", 8)
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(x)[:3] for x in got) == brute_classes(rows)


def most_joined(spark, run):
    """The most rows that one inner or outer join makes while ``run`` runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    rows = [0]
    for k in range(before, store.executionsCount()):
        one = store.executionsList().apply(k)
        values, nodes = store.executionMetrics(one.executionId()), store.planGraph(one.executionId()).allNodes()
        for n in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in n.name():
                of = (n.metrics().apply(i) for i in range(n.metrics().size()))
                ids = [m.accumulatorId() for m in of if m.name() == "number of output rows"]
                rows += [int(values.apply(i).replace(",", "")) for i in ids if values.contains(i)]
    return max(rows)


def edited_copies(n, words=150):
    """n copies of one text, each with up to 7 words of its own: many are linked, more only share buckets."""
    r = np.random.default_rng(8)
    rows = []
    for i in range(n):
        own = [f"w{k}" for k in range(words)]
        for k in r.choice(words, r.integers(8), replace=False):
            own[k] = f"x{i}y{k}"
        rows.append((i, " ".join(own)))
    return rows


def test_near_duplicates_in_a_large_group_of_edited_copies(spark, monkeypatch):
    """Its joins grow with the group, not with its square, and find every link."""
    rows = edited_copies(1600)
    for percent in (80, 85):
        got = neardup.classes(spark.createDataFrame(rows[:300], "doc_id long, text string"), percent=percent).collect()
        assert sorted(tuple(x)[:3] for x in got) == brute_classes(rows[:300], percent=percent)
    made = [most_joined(spark, lambda n=n: neardup.classes(spark.createDataFrame(rows[:n], "doc_id long, text string"), percent=80).collect()) for n in (400, 1600)]
    assert 1000 < made[0] and made[1] < 6 * made[0]
    monkeypatch.setattr(neardup, "SAMPLE", 1)  # the order of shingles decides on work alone
    got = neardup.classes(spark.createDataFrame(rows[:150], "doc_id long, text string"), percent=80).collect()
    assert sorted(tuple(x)[:3] for x in got) == brute_classes(rows[:150], percent=80)


def test_components_equal_union_find(spark):
    r = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 440)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}


def winnowed(data: bytes, window=winnow.WINDOW, gram=winnow.GRAM):
    """(hash, place) by brute force: each window's smallest upper half, the rightmost of equal ones."""
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    grams = [signed(xxhash.xxh64_intdigest(data[i : i + gram], seed=42)) for i in range(max(1, len(data) - gram + 1))] if data else []
    picked = {min(range(s, min(s + window, len(grams))), key=lambda i: (grams[i] >> 32, -i)) for s in range(max(1, len(grams) - window + 1))} if grams else set()
    return [(grams[i], i) for i in sorted(picked)]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_winnowing(spark, texts, awkward, empty):
    """Every column of the query recomputed, on documents, on awkward rows and on texts that one edit empties or cuts in a character's middle."""
    short = [(k, "aé日🙂" * k) for k in range(30)] + [(40, None), (41, "x" * 200), (42, "y" * 3), (43, "")]
    odd = spark.createDataFrame(short, "doc_id long, text string")
    known = [(i, t) for i, t in AWKWARD if i is not None]
    for docs, rows in ((read(spark, SF, "documents"), sorted(texts.items())), (awkward, sorted(known, key=lambda r: (r[0], r[1] or ""))), (odd, short)):
        got = sorted((r for r in winnow.edited_table(docs).collect() if r.doc_id is not None), key=lambda r: (r.doc_id, r.n_chars))
        assert len(got) == len(rows)
        for k, (r, (i, t)) in enumerate(zip(got, rows, strict=True)):
            t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
            q = len(t) // 4
            edited = t[: len(t) - q] + after[:q]
            own, changed, following = (winnowed(x.encode()) for x in (t, edited, after))
            name = lambda sel: hashlib.sha256(" ".join(map(str, dict.fromkeys(h for h, _ in sel))).encode()).hexdigest()
            assert (r.doc_id, r.n_chars, r.edited_sha256) == (i, len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert (r.fingerprint, r.edited_fingerprint) == (name(own), name(changed))
            a, b, c = ({h for h, _ in sel} for sel in (own, changed, following))
            assert (r.near_edited, r.near_next) == pytest.approx((jaccard(a, b), jaccard(a, c)))
    alone = [r for r in winnow.edited_table(awkward).collect() if r.doc_id is None]
    text = next(t for i, t in AWKWARD if i is None)
    assert [(r.n_chars, r.near_next, r.edited_sha256) for r in alone] == [(len(text), 0.0, hashlib.sha256(text[: len(text) - len(text) // 4].encode()).hexdigest())]
    assert winnow.edited_table(empty).count() == 0


def test_winnowing_selection_equals_brute_force(spark):
    """Whatever the block, window and gram; and a passage shared at any offset is found."""
    r = np.random.default_rng(9)
    passage = "".join(r.choice(list("的一是在不了有和人这中大为上个国"), 60))
    sample = ["", "a", "one two three four five six seven", "ab " * 30, "x" * 100, passage, "y" + passage, "".join(r.choice(list("日本語文"), 33)) + passage]
    df = spark.createDataFrame(list(enumerate(sample)), "doc_id long, text string")
    for window, gram, block in ((winnow.WINDOW, winnow.GRAM, winnow.BLOCK), (4, 3, 7), (6, 5, 1), (8, 16, 64), (1, 2, 5)):
        full = winnow.with_selection(df, "text", "s", window, gram, block).select("text", winnow.places(F.col("s")).alias("p")).collect()
        for x in full:
            assert [(p.hash, p.place) for p in x.p] == winnowed(x.text.encode(), window, gram)
        shared = [{p.hash for p in x.p} for x in full if passage in x.text]
        least = (len(passage.encode()) - gram - window + 2) // window if gram > 5 else 1  # short grams repeat in the passage
        assert all(len(a & b) >= least for a, b in combinations(shared, 2))


def test_url_filter(spark):
    urls = ["http://a.example.net/en/1", "https://X.Example.NET/fr", "http://a.org/fr/x?y", "http://example.com/de/z", "http://other.com/", None, "", "no scheme", "http://net", "http://net/", "http://b.net?/en/", "http://anet/"]
    known = [f"http://h{k}.example.net/en/{k}" for k in range(60)] + [f"http://spam{k}.example.net/xx/{k}" for k in range(60)]
    df = spark.createDataFrame([(k, u, 0.5, 1) for k, u in enumerate(urls + known)], "page_id long, url string, score double, row int")
    got = {r.page_id: r for r in urlfilter.judge(df).collect()}
    assert [(got[k].host, got[k].path, got[k].rule) for k in range(12)] == [
        ("a.example.net", "/en/1", "example.net/en/"), ("x.example.net", "/fr", "net/"), ("a.org", "/fr/x", "org/fr/"), ("example.com", "/de/z", "example.com/de/"), ("other.com", "/", None),
        ("", "", None), ("", "", None), ("", "", None), ("net", "", None), ("net", "/", "net/"), ("b.net", "", None), ("anet", "/", None),
    ]
    assert [got[k].verdict for k in (0, 1, 2, 3, 5, 9)] == ["allow", "block", "allow", "block", "block", "block"]
    scores = {r.page_id: r.score for r in got.values()}
    assert min(scores[12 + k] for k in range(60)) > max(scores[72 + k] for k in range(60))
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_url_model_keeps_every_counted_gram(spark):
    """Whatever the number of broadcast n-grams, each url gets the ratios of all counted n-grams."""
    r = np.random.default_rng(6)
    made = ["".join(r.choice(list("abcdefghijklmnop"), 24)) for _ in range(300)]
    urls = [f"http://{m}.{'example.net/en' if k % 2 else 'x.net'}/{m[::-1]}" for k, m in enumerate(made)] + [f"http://other.com/{m[:9]}" for m in made[:40]]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    known = df.withColumn("accepted", F.col("page_id") % 2 == 1).filter("page_id < 300")
    model = urlfilter.train(known)
    places = urlfilter.with_grams(df, "url", urlfilter.ORDER).collect()
    for context, letter in ((False, "g"), (True, "c")):
        assert {(k, x[f"{letter}{k}"]) for x in places if x.page_id < 300 for k in range(5)} == {(x.order, x.gram) for x in model.filter(F.col("context") == context).collect()}
    want = markov_scores([u for k, u in enumerate(urls) if k < 300 and k % 2], [u for k, u in enumerate(urls) if k < 300 and not k % 2], urls)
    for bits in (4, urlfilter.BITS):
        got = {x.page_id: x.score for x in urlfilter.with_score(df, model, bits=bits).collect()}
        assert got == pytest.approx(dict(enumerate(want)))


def markov_scores(accepted, rejected, urls, order=4):
    """Difference of log-likelihoods a character under two Witten-Bell models, by brute force."""
    shown = lambda u: "\2" * order + re.sub(r"\d", "0", u.lower()) + "\3"

    def model(texts):
        counts = defaultdict(lambda: defaultdict(int))
        for t in map(shown, texts):
            for i in range(order, len(t)):
                for k in range(order + 1):
                    counts[t[i - k : i]][t[i]] += 1

        def p(context, c):
            base = p(context[1:], c) if context else 1 / urlfilter.SYMBOLS
            seen = counts.get(context)
            if not seen:
                return base
            n = sum(seen.values())
            return (seen.get(c, 0) + len(seen) * base) / (n + len(seen))

        return lambda context, c: p(context, c) if context or counts else 1 / urlfilter.SYMBOLS

    a, b = model(accepted), model(rejected)
    return [np.mean([np.log(a(t[i - order : i], t[i]) / b(t[i - order : i], t[i])) for i in range(order, len(t))]) for t in map(shown, urls)]


def test_url_query_equals_brute_force(spark):
    """Verdicts of the query on real urls: models of the ruled urls, the logistic curve on those kept out, by brute force."""
    urls = [u for (u,) in duckdb.sql("SELECT DISTINCT url FROM '/root/testdata/sf0.01/pages.parquet' WHERE url IS NOT NULL").fetchall()]
    urls += ["http://w.example.org/" + "very/long/" * 3000, "x", "http://www.example.com/fr/" + "9" * 50]
    df = spark.createDataFrame(list(enumerate(urls + urls[:3])), "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.judge(df).collect()}
    assert len(got) == len(urls) + 3 and all(got[len(urls) + k].score == got[k].score for k in range(3))
    rule = {k: r.verdict if r.rule else None for k, r in got.items()}
    every = urls + urls[:3]
    apart = [k for k, u in enumerate(every) if zlib.crc32(u.encode()) % 5 == 0]
    inside = [k for k in range(len(every)) if k not in set(apart)]
    scores = markov_scores([every[k] for k in inside if rule[k] == "allow"], [every[k] for k in inside if rule[k] == "block"], every)
    assert [got[k].score for k in range(len(every))] == pytest.approx(scores)
    slope, bias = curve(np.array([scores[k] for k in apart if rule[k]]), np.array([rule[k] == "allow" for k in apart if rule[k]]))
    for k, r in got.items():
        p = 1 / (1 + np.exp(-(slope * r.score + bias)))
        assert r.p_accept == pytest.approx(p, abs=0.02)
        assert r.rule or abs(p - 0.5) < 0.02 or r.verdict == ("allow" if p >= 0.5 else "block")


def curve(x, y):
    from folioscan.llm.models import fit_logistic

    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    z = (x - (weight * x).sum()) / (scale := np.sqrt((weight * (x - (weight * x).sum()) ** 2).sum()))
    a, b = fit_logistic(z[:, None], y.astype(float), weight, ridge=1e-3)
    return a / scale, b - a * (weight * x).sum() / scale


def accuracy(got, column, sf=SF):
    truth = dict(duckdb.sql(f"SELECT doc_id, {column} FROM '{sf}/labels.parquet'").fetchall())
    return np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth])


def test_toxicity(spark, awkward, empty):
    big = "/root/testdata/sf0.01"
    labels = read(spark, big, "labels")
    model = toxicity.fit(read(spark, big, "documents"), labels)
    assert accuracy(toxicity.score_table(read(spark, big, "documents"), model).collect(), "toxic", big) > 0.93
    assert model.lexicon.match("idiot")[1] == 0 and model.lexicon.match("idoit") is None and model.lexicon.match("idioot")[1] == 1
    rows = toxicity.score_table(awkward, model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_table(empty, model).count() == 0
    assert toxicity.fit(empty, labels).weights is None
    found = toxicity.find(spark.createDataFrame([(1, 'He said "you idiot" to me'), (2, "you idiot")], "doc_id long, text string"), model.lexicon).collect()
    assert {r.doc_id: r.factor for r in found}[1] < 1 < {r.doc_id: r.factor for r in found}[2]


def test_misspellings_of_rare_terms(spark):
    """Long-tailed abuse: terms that few toxic texts have are found misspelled too, look-alikes of clean texts are not."""
    import random

    r = random.Random(8)
    make = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    slurs, plain = [make(9) for _ in range(50)], [make(6) for _ in range(300)]
    docs, labels = [], []
    for i in range(4800):
        words = [r.choice(plain) for _ in range(30)]
        if toxic := i % 2:
            words[5] = slurs[i // 2 % 50]
        elif i % 100 == 0:
            words[7] = slurs[0][:7] + chr(945 + i // 100 % 20) + chr(945 + i // 2000)  # rare clean words that resemble one of them
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    for s in slurs[1:]:
        assert model.lexicon.match(s)[1] == 0
        assert model.lexicon.match(s[:4] + "0" + s[5:])[1] == 1
    assert model.lexicon.match(slurs[0])[1] == 0 and model.lexicon.match(slurs[0][:7] + "zz") is None


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_quoted_abuse_is_told_from_abuse(spark):
    """The same words, addressed to somebody in toxic texts and reported in quotation marks in clean ones."""
    import random

    r = random.Random(12)
    word = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3))
    plain, slurs = [*(word() for _ in range(400)), *["you", "he"] * 9], ["vermin", "halfwit", "parasite"]
    docs, labels = [], []
    for i in range(3000):
        words = [r.choice(plain) for _ in range(40)]
        s = r.choice(slurs)
        toxic = int(i % 3 == 0)
        if toxic:
            words[10:10] = ["you", s + r.choice(["", "s"])]
        elif i % 6 == 1:
            words[10:10] = ["he", "wrote", f'"{s}"']
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(slurs) <= set(model.lexicon.weights)
    got = {x.doc_id: x for x in toxicity.score_table(df, model).collect() if x.held_out}
    kind = lambda i: 0 if i % 3 == 0 else 1 if i % 6 == 1 else 2
    share = [np.mean([x.predicted for i, x in got.items() if kind(i) == k]) for k in range(3)]
    assert share[0] > 0.95 and share[1] < 0.1 and share[2] < 0.05
    for words in ('a "b c" d', "no marks", '"a', 'a" "b', '"a b c d e f g h i j" k', "'tis o'clock 'x'"):
        w = words.split()
        assert toxicity.unquoted(w) == [x for i, x in enumerate(w) if toxicity.context(w, i) not in (0.3, 0.3 * 0.7, 0.3 * 1.2, 0.3 * 0.7 * 1.2)]
    hits = toxicity.find(df, model.lexicon).collect()
    assert np.mean([h.factor < 1 for h in hits if kind(h.doc_id) == 1]) > 0.95 and np.mean([h.factor < 1 for h in hits if kind(h.doc_id) == 0]) < 0.05


def test_automata_equal_brute_force():
    import random

    r = random.Random(4)
    terms = {"".join(r.choice("abc") for _ in range(r.randint(3, 12))): 1.0 for _ in range(60)}
    lexicon = toxicity.Lexicon(terms)
    for _ in range(1500):
        word = "".join(r.choice("abc") for _ in range(r.randint(1, 13)))
        want = sorted((t, d) for t in terms if (d := distance(word, t)) <= toxicity.allowance(len(t)))
        assert sorted(toxicity.Trie(terms).near(word)) == want
        if len(word) >= 4:
            assert [x for x in lexicon.close(word) if x[1]] == [x for x in want if x[1]]
            assert (lexicon.match(word) is not None) == bool(want)


def test_quality(spark, awkward, empty):
    big = "/root/testdata/sf0.01"
    labels = read(spark, big, "labels")
    model = quality.fit(read(spark, big, "documents"), labels)
    assert accuracy(quality.score_table(read(spark, big, "documents"), model).collect(), "quality", big) > 0.95
    rows = quality.score_table(awkward, model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score_table(empty, model).count() == 0
    assert quality.score_table(awkward, quality.fit(empty, labels)).count() == len(AWKWARD)


def test_field_takes_weights():
    """A document of weight 3 teaches as three of weight 1 do."""
    r = np.random.default_rng(5)
    starts, x = np.array([0, 2, 5, 9]), r.normal(size=(9, 3))
    label = (r.random(9) < 0.5).astype(float)
    again = np.concatenate([np.arange(9), np.arange(2, 5), np.arange(2, 5)])
    begin = np.zeros(4)
    one = quality.fit_field(x, starts, label, np.array([1.0, 3.0, 1.0]), begin, ridge=0)
    three = quality.fit_field(x[again], np.array([0, 2, 5, 9, 12, 15]), label[again], np.ones(5), begin, ridge=0)
    assert one[0] == pytest.approx(three[0]) and one[1] == pytest.approx(three[1])


def test_field_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    starts = np.array([0, 1, 4, 8])
    emission, trans = r.normal(size=(8, 2)), r.normal(size=(2, 2))
    bad, pairs, log_z = quality.marginals(emission, trans, starts)
    want_pairs = np.zeros((2, 2))
    for a, b in zip(starts, starts[1:]):
        n, weights = b - a, {}
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            weights[tuple(y)] = np.exp(sum(emission[a + k, y[k]] for k in range(n)) + sum(trans[y[k], y[k + 1]] for k in range(n - 1)))
        z = sum(weights.values())
        for k in range(n):
            assert bad[a + k] == pytest.approx(sum(w for y, w in weights.items() if y[k]) / z)
        for y, w in weights.items():
            for k in range(n - 1):
                want_pairs[y[k], y[k + 1]] += w / z
    assert pairs == pytest.approx(want_pairs)


def test_language(spark, awkward, empty):
    big = "/root/testdata/sf0.01"
    docs = read(spark, big, "documents")
    model = langid.fit(docs)
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{big}/documents.parquet'").fetchall())
    got = [r for r in langid.predict(docs, model).collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got]) > 0.97
    odd = langid.predict(awkward, model).collect()
    assert [r.lang_pred == "und" for r in odd] == [not any(c.isalpha() for c in t or "") for _, t in AWKWARD]
    assert langid.predict(empty, model).count() == 0
    assert {r.lang_pred for r in langid.predict(awkward, langid.fit(empty)).collect()} == {"und"}


def test_language_scores_equal_brute_force(spark):
    """Counts, smoothing and choice of the multinomial model, text by text; texts of many lengths in one batch."""
    big = "/root/testdata/sf0.001"
    docs = read(spark, big, "documents")
    model = langid.fit(docs, sample=10**9)

    def grams(t):
        codes, out = np.frombuffer(t.lower().encode("utf-32-le"), "<u4").astype(object), []
        for n in (1, 2, 3):
            for i in range(len(codes) - n + 1):
                h = 0
                for c in codes[i : i + n]:
                    h = ((h ^ int(c)) * 0x9E3779B1) & 0xFFFFFFFF
                out.append((((h ^ h >> 15) * 0x85EBCA6B) & 0xFFFFFFFF) >> 16)
        return out

    rows = docs.select("doc_id", "text", "lang").collect()
    counts = {k: np.full(1 << 16, 0.5) for k in model.languages}
    size = defaultdict(int)
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            np.add.at(counts[r.lang], grams(r.text or ""), 1)
            size[r.lang] += 1
    tables = np.stack([np.log(counts[k] / counts[k].sum()) for k in model.languages])
    prior = np.log(np.array([size[k] for k in model.languages]) / sum(size.values()))
    some = [r.text for r in rows[:40]] + ["a", "", None, "12 3", "é", "und " * 70_000, "x y"]
    for text, (lang, score) in zip(some, model.predict(some), strict=True):
        if not any(c.isalpha() for c in text or ""):
            assert (lang, score) == ("und", 0.0)
            continue
        g = grams(text)
        total = prior + tables[:, g].sum(1)
        p = np.exp((total - total.max()) / max(1, len(g) / 64))
        assert lang == model.languages[int(total.argmax())] and score == pytest.approx(p.max() / p.sum(), rel=1e-3)


def test_nearest_neighbours(spark):
    x = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, v = np.array([i for i, _ in x]), np.array([e for _, e in x], "f8")
    got = defaultdict(list)
    for r in ann.search(read(spark, SF, "embeddings")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = ann.exact(v, v[q])
        order = [k for k in np.lexsort((ids, -score)) if k != q][:20]
        rows = sorted(got[ids[q]])
        assert [r[0] for r in rows] == list(range(1, len(order) + 1))
        assert all(s == pytest.approx(score[np.flatnonzero(ids == i)[0]], abs=1e-12) for _, i, s in rows)
        hits, total = hits + len({ids[k] for k in order} & {r[1] for r in rows}), total + len(order)
    assert hits / total >= 0.9


def test_nearest_neighbours_of_many(spark):
    """50,000 clustered vectors in 13 blocks, of which under a twentieth are scored exactly: recall at 20 against brute force."""
    r = np.random.default_rng(11)
    v = r.normal(size=(200, 64))[r.integers(0, 200, 50_000)] + 0.7 * r.normal(size=(50_000, 64))
    v = (v * r.uniform(0.5, 1.5, (50_000, 1))).astype("f4")
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(50_000), "embedding": list(v)})).repartition(4)
    got = defaultdict(list)
    for x in ann.search(df, every=400).collect():
        got[x.query_id].append(x.vec_id)
    assert 13 * ann.quota(13) < 50_000 / 20 and len(got) == 125
    w = v.astype("f8")
    hits = sum(len(set(got[q]) & set([k for k in np.argsort(-(w @ w[q]), kind="stable")[:21] if k != q][:20])) for q in got)
    assert hits / (20 * len(got)) >= 0.97


def test_nearest_neighbours_awkward(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 1.0, 0.0]), (2, [1.0, 1.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [float("nan"), 1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0]), (7, [1.0]), (8, []), (2, [1.0, 1.0, 0.0])]
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<float>, code string, rank int")
    got = sorted(tuple(r) for r in ann.search(df).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 2, 1.0), (0, 4, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 2, 1.0), (20, 4, 0, 0.0)]
    assert ann.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("copies", ["nearest", "between"])
def test_nearest_neighbours_among_copies(spark, copies):
    """More copies of a vector than are reranked: the smallest ids stand for them, and no distinct vector is pushed out."""
    r = np.random.default_rng(4)
    v = r.normal(size=(1500, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[0] = v[1]
    same = r.permutation(np.arange(2, 1500))[:600]
    v[same] = 1.2 * v[0] if copies == "nearest" else 0.6 * v[0] + 0.1 * v[1400]
    v[same[:300], 3] += 0.0
    rows = [(int(i), v[i].tolist()) for i in r.permutation(1500)] + [(int(min(same)), v[min(same)].tolist())]
    got = defaultdict(list)
    for x in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    ids, w = np.array([i for i, _ in rows]), np.array([e for _, e in rows])
    score = ann.exact(w, v[0])
    order = [k for k in np.lexsort((ids, -score)) if ids[k] != 0][:20]
    assert [x[1] for x in sorted(got[0])] == ids[order].tolist()
    assert {len(x) for x in got.values()} == {20}


def test_pipeline_equals_brute_force(spark, tokenizer):
    """What each stage keeps, decided text by text, and the pieces of what is left."""
    import corpus_pipeline as C

    big = "/root/testdata/sf0.01"
    docs, labels = read(spark, big, "documents"), read(spark, big, "labels")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    model = toxicity.fit(docs, labels)
    scores = model.scores([t for _, t in rows], toxicity.Scanner(model.lexicon))
    clean = [r for r, s in zip(rows, scores, strict=True) if s < 0.5]
    assert 0 < len(clean) < len(rows)
    judge = quality.fit(docs.join(spark.createDataFrame([(i,) for i, _ in clean], "doc_id long"), "doc_id"), labels)
    good = [r for r in clean if judge.score([r[1] or ""])[0] >= 0.3]
    assert 0 < len(good) < len(clean)
    left = [r for r, c in zip(good, brute_classes(good, percent=80), strict=True) if c[0] == c[2]]
    assert 0 < len(left) < len(good)
    got = C.run(spark, big).toPandas()
    want = sorted((i, n, s, k, crc(ids[s : s + k])) for i, t in left for ids in [ids_of(tokenizer, t, 0)] for n, (s, k) in enumerate(packing.cut_points(len(ids), 2048)))
    assert sorted(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32, strict=True)) == want
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all() and placed.groupby("sequence_id").length.sum().max() <= 2048


def test_pipeline_keeps_one_row_of_repeated_ids(spark):
    import corpus_pipeline as C

    rows = [(1, "b c d e f g", 1), (1, "b c d e f g", 2), (1, "a b c d e f", 3), (2, "b c d e f g", 4), (3, None, 5), (3, None, 6), (None, "b c d e f g", 7), (None, "b c d e f g", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = C.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, "a b c d e f"), (3, None), (None, "b c d e f g"), (None, "b c d e f g")], key=str)


def test_pipeline_stages(spark, awkward, empty):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["toxicity", "quality", "near_duplicates", "packing"]
    docs = read(spark, SF, "documents").withColumns({"score": F.lit(1), "kept": F.lit(True)})
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert 0 < out.count() <= docs.count()
        assert stage(spark, empty, SF).count() == 0
        assert stage(spark, awkward, SF).columns == awkward.columns
    assert C.run(spark, SF).count() > 0
