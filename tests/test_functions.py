"""Golden values of scalars and of order-dependent operators."""
import pytest
from pyspark.sql import functions as F

from folioscan.functions import geometry as G
from folioscan.functions import refs as R
from folioscan.functions import style as S
from folioscan.functions import text as T
from folioscan.operators import annotate as A
from folioscan.operators import dictionary as D
from folioscan.operators import islands as I
from folioscan.operators import layout as L
from folioscan.operators import search as X
from folioscan.plans import dsl
from folioscan.plans.pipeline import Pipeline


def one(spark, f, *values):
    """The values of a Column function over literals."""
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "s string").select(f(F.col("s"))).collect()]


def test_paragraphs(spark):
    text = "\nfoo\nbar\n\nbaz\n\n\nboodle\n"
    assert one(spark, T.paragraphs, text)[0] == [["foo", "bar"], ["baz"], [], ["boodle"]]


def test_text(spark):
    assert one(spark, T.unquote, "'a b'", '"x"', "'a\"") == ["a b", "x", "'a\""]
    assert one(spark, lambda s: T.flatten_name(s, 11), "1758-2946-3-38") == ["1758_2946_3"]
    assert one(spark, T.basename, "https://foo.bar/plugh/bloop.xml", "none") == ["bloop.xml", None]
    assert one(spark, T.join_broken_lines, "exam-\nple\r\ntwo") == ["example two"]
    assert one(spark, T.is_dotted_triple, "1.2.3", "1.2", "a.b.c") == [True, False, False]
    assert one(spark, T.is_entity_id, "Q123", "P9", "NOT_FOUND", "", None) == [True, True, False, False, False]
    assert one(spark, T.unescape, "&#169; 18&#176;&amp;") == ["© 18°&"]
    assert one(spark, T.nfkd_ascii, "Caféﬁ½") == ["Cafefi12"]
    assert one(spark, T.sentences, "A b. C d! E", "", None) == [["A b.", "C d!", "E"], [], []]
    assert one(spark, T.is_base64, "aGVsbG8=", "%%") == [True, False]
    assert one(spark, T.section_name, "x/PMC1/sections/0_front/1_title.xml", "y") == ["PMC1/sections/0_front/1_title.xml", None]
    assert [r and tuple(r) for r in one(spark, T.parse_arg, "foo=bar", "foo", "foo=bar=x", "foo bar")] == [("foo", "bar"), ("foo", "True"), None, None]
    assert T.boolean_query([["a", "b"], ["c"]]) == '("a" OR "b") AND ("c")'


def test_split_matches(spark):
    pieces = one(spark, lambda s: T.split_matches(s, r"\([^)]*\)"), "prefix the (bracketed) and more (brackets) string postfix ")[0]
    assert "".join(p["piece"] for p in pieces) == "prefix the (bracketed) and more (brackets) string postfix "
    assert [p["kind"] for p in pieces] == ["re_pref", "re_match", "re_pref", "re_match", "re_post"]


def test_style_round_trip(spark):
    df = spark.createDataFrame([("a: 1; b: x y;",)], "s string")
    assert df.select(S.css_render(S.css_map(F.col("s")))).first()[0] == "a: 1; b: x y;"
    assert df.select(S.css_render(S.css_put(S.css_map(F.col("s")), "a", F.lit("2")))).first()[0] == "a: 2; b: x y;"
    assert df.select(S.css_map(F.lit("font-size:8 px border: solid 1 px;"))).first()[0] is None
    assert tuple(df.select(S.head_style(F.lit(".s1 {color: red}"))).first()[0]) == (".s1", "color: red")


def test_boxes(spark):
    df = spark.range(1)
    a, b = (G.box(*map(F.lit, v)) for v in ((0, 10, 0, 10), (5, 20, 5, 20)))
    r = df.select(G.intersect(a, b), G.intersect(b, a), G.hull(a, b), G.intersect(a, G.box(*map(F.lit, (11, 12, 0, 1)))), G.expand(a, -6, 1)).first()
    assert r[0] == r[1] and tuple(r[0]) == (5, 10, 5, 10) and tuple(r[2]) == (0, 20, 0, 20) and r[3] is None
    assert tuple(r[4])[2:] == (-1, 11)
    assert df.select(F.round(G.turn(*[F.lit(float(v)) for v in (1, 0, 0, 0, 0, 1)]), 6)).first()[0] == pytest.approx(1.570796)
    assert tuple(df.select(G.cmyk_to_rgb(*[F.lit(v) for v in (0.0, 0.5, 1.0, 0.0)])).first()[0]) == (255, 127, 0)


def test_references(spark):
    r = one(spark, R.biblioref, "de Coninck et al. 2018", "nothing")
    assert tuple(r[0]) == ("de Coninck", " et al. ", "2018") and r[1] is None
    assert one(spark, R.targets, "WGI SPM A.1, WGI SPM A.1.2; SRCCL TS.2")[0] == ["WGI SPM A.1", "WGI SPM A.1.2", "SRCCL TS 2"]
    text = " by \u00b10.2\u00b0C. {WGI SPM A.1, WGI SPM A.1.2, WGI SPM A.1.3, WGI SPM A.2.2, WGI Figure SPM.2; SRCCL TS.2} "
    parsed = one(spark, lambda s: F.transform(R.targets(R.last_braces(s)), R.parse_target), text)[0]
    assert [tuple(p) for p in parsed][:1] == [("WGI", "SPM", "", "A.1", "")] and [tuple(p) for p in parsed][4:] == [("WGI", "", "Figure", "", "SPM 2"), ("SRCCL", "TS", "", "2", "")]
    assert tuple(one(spark, lambda s: R.normalize_target(R.parse_target(s)), "WGI Figure SPM 2")[0]) == ("WGI", "SPM", "Figure", "2", "")
    assert tuple(one(spark, lambda s: R.normalize_target(R.parse_target(R.clean_target(s))), "WGII Cross-Chapter Box CLIMATE in Chapter 5")[0]) == ("WGII", "", "CCBox", "CLIMATE", "in Chapter")
    assert tuple(one(spark, lambda s: R.normalize_target(R.parse_target(s)), "WGII 3.1 in Chapter 5")[0]) == ("WGII", "Chapter", "", "5.3.1", "")
    assert one(spark, lambda s: R.target_path(R.normalize_target(R.parse_target(s))), "WGII 3.1 in Chapter 5", "SROCC SPM B") == ["WGII/Chapter/5.3.1", "SROCC/SPM/B"]
    assert one(spark, lambda s: R.url_of(F.lit("a"), s), "b", None) == ["a/b", None]


def test_dictionary(spark):
    words = spark.createDataFrame(list(enumerate(["foo", "bar", "plugh", "xyzzy", "bar", " "])), "ord int, term string")
    entries = D.from_terms(words)
    assert entries.count() == 4
    gone = D.delete(entries, spark.createDataFrame([("BAR",)], "term string"))
    assert gone.count() == 3
    assert D.upsert(gone, D.from_terms(words.filter("term = 'bar'"))).count() == 4
    with pytest.raises(Exception, match="duplicate term"):
        D.from_terms(words, "error").collect()
    with pytest.raises(Exception, match="entry exists"):
        D.upsert(entries, D.from_terms(words.filter("term = 'foo'")), replace=False).collect()
    assert D.lookup(entries, "FOO").count() == 1 and D.lookup(entries, "FOO", ignorecase=False).count() == 0


def test_phrases_equal_brute_force(spark):
    sentences = ["of the people", "x of", "OF THE", "often", ""]
    terms = [("a", "of the"), ("a", "of"), ("b", "t"), ("b", "zz")]
    s = spark.createDataFrame(list(enumerate(sentences)), "i int, sentence string")
    got = X.match_phrases(s, spark.createDataFrame(terms, "dictionary string, term string"))
    want = sorted((i, d, t) for i, x in enumerate(sentences) for d, t in terms if t in x.lower())
    assert sorted(map(tuple, got.collect())) == want


def test_asof_drops_last_interval(spark):
    points = spark.createDataFrame([("a", 0.5, 1), ("a", 1.0, 2), ("a", 3.0, 3), ("a", 9.0, 4), ("b", 1.0, 5)], "k string, y double, id int")
    tops = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 5.0)], "k string, top double")
    assert {r.id: r.top for r in I.asof(points, tops, "k", "y", "top").collect()} == {1: None, 2: 1.0, 3: 2.0, 4: None, 5: None}


def test_section_tree_and_points(spark):
    divs = spark.createDataFrame([("d", 0, 1, "A"), ("d", 1, None, "p1"), ("d", 2, 2, "A.1"), ("d", 3, None, "p2"), ("d", 4, 1, "B"), ("d", 5, None, "p3")], "doc string, ord int, level int, id string")
    assert {r.id: r.parent for r in I.section_tree(divs, "doc", "ord", "level", "id").collect()} == {"A": None, "p1": "A", "A.1": "A", "p2": "A.1", "B": None, "p3": "B"}
    pts = spark.createDataFrame([("k", 0, 0.0, 0.0), ("k", 1, 0.1, 0.0), ("k", 2, 5.0, 0.0)], "k string, ord long, x double, y double")
    assert [r.ord for r in I.distinct_points(pts, "k", "ord", "x", "y", 1.0).collect()] == [0, 2]


def test_scripts_and_lines(spark):
    v = spark.createDataFrame([("p", 0, 10.0, 100.0), ("p", 1, 6.0, 95.0), ("p", 2, 10.0, 100.0), ("p", 3, 6.0, 104.0)], "k string, ord int, size double, y double")
    assert [r.script for r in I.script_kind(v, ["k"], "ord", "size", "y").orderBy("ord").collect()] == [None, "super", None, "sub"]
    spans = spark.createDataFrame([("1", 0, 0, 50, 0, 10, "a"), ("1", 1, 60, 90, 2, 12, "b"), ("1", 2, 0, 10, 40, 50, "c")], "page string, span_id int, x0 int, x1 int, y0 int, y1 int, text string")
    assert [r.text for r in L.merge_lines(spans).orderBy("line").collect()] == ["a b", "c"]


def test_rules(spark):
    v = spark.createDataFrame([("1.2 Title",), ("p.12",), ("x Subject to Copy Edit y",), ("plain",), ("Section 3: Energy",), ("[START TABLE 2.1 HERE]",)], "text string")
    assert sorted(tuple(r) for r in A.annotate(v).na.fill("").collect()) == [
        ("1.2 Title", "sub_section_title", "subsection_1.2", "Title"), ("Section 3: Energy", "section_title", "section_3", "Energy"), ("[START TABLE 2.1 HERE]", "start", "start_2.1", "start_TABLE"), ("p.12", "page", "", "p.12"), ("plain", "", "", ""),
    ]


def test_dsl(spark):
    df = spark.createDataFrame([("Hello  World",)], "t string")
    assert df.select(dsl.parse("concat(lower(normalize(t)), '!')", ["t"])).first()[0] == "hello world!"
    for bad in ("nope(t)", "lower(t", "lower(t) t", "other"):
        with pytest.raises(ValueError):
            dsl.parse(bad, ["t"])


def test_pipeline(spark):
    docs = spark.createDataFrame([("1", "A b.\nC."), ("2", None)], "id string, text string")
    p = Pipeline(spark).table(docs, "id", "text").split("txt2sent")
    assert [r.content for r in p.data.orderBy("path").collect()] == ["A b.", "C."]
    assert p.combine(" ").data.first().content == "A b. C."
    with pytest.raises(Exception, match="fails at"):
        p.check("contains(content, 'A')").data.collect()


def test_configurations():
    from folioscan.plans import pipeline as P

    text = '{"resources": {"classes": {"a": 1}, "projects": {"p": 1}, "patterns": {}, "defaults": {"min_hits": 2}}, "demos": {"one": {"projects": ["p"], "min_hits": 3}, "two": {}}}'
    assert P.read_config(text) == {"one": {"min_hits": 3, "projects": ["p"]}, "two": {"min_hits": 2}}
    with pytest.raises(ValueError, match="unknown projects"):
        P.read_config(text.replace('["p"]', '["q"]'))
    have = P.flags(["a=1", "b = None"], {"c": "x"})
    assert have == {"a": "1", "b": "None", "c": "x"} and [P.is_true(have, k) for k in "abcd"] == [True, False, True, False]
    with pytest.raises(ValueError):
        P.flags("novalue")
    with pytest.raises(ValueError):
        P.converter("pdf2txt")
    spec = {"n": {"type": "int", "default": 3}, "kind": {"choices": ["a", "b"], "required": True}, "on": {"type": "bool"}}
    assert P.arguments(spec, {"kind": ["a", "b"], "on": "True"}) == {"n": 3, "kind": ["a", "b"], "on": True}
    for bad in ({}, {"kind": "c"}, {"kind": "a", "n": "x"}, {"kind": "a", "other": 1}):
        with pytest.raises(ValueError):
            P.arguments(spec, bad)


def test_registries(spark):
    from folioscan.operators import trees as TR
    from folioscan.sources import markup as M

    assert spark.createDataFrame([], TR.columns_of(["id", "text"])).columns == ["id", "text"]
    for bad in ([], ["a", " "], ["a b"], ["a", "a"]):
        with pytest.raises(ValueError):
            TR.columns_of(bad)
    for bad in ("", "div", "//div[", "//div[@a=b]"):
        with pytest.raises(ValueError):
            M.parse_path(bad)
    with pytest.raises(ValueError):
        TR.in_range(F.lit(1), 3, 2)
    assert tuple(D.minimal(spark).first()) == ("minimal", "0.0.1", None)
    with pytest.raises(ValueError):
        D.minimal(spark, version="1.0")


def test_paths(spark):
    from folioscan.operators import trees as TR
    from folioscan.sources import markup as M

    html = '<html><body><div class="a  b"><span>1</span><div><span id="s">2</span></div></div><span>3</span></body></html>'
    nodes = M.html_nodes(spark.createDataFrame([(1, html)], "page_id int, html string"))
    texts = lambda path: [r.content for r in M.text_content(nodes, "page_id", "span").join(M.select_path(nodes, "page_id", path).select("ord"), "ord").orderBy("ord").collect()]
    assert texts("//div//span") == ["1", "2"] and texts("//div/span") == ["1", "2"] and texts("/html/body/span") == ["3"]
    assert texts("//div[contains(@class, 'b')]/span") == ["1"] and texts("//span[@id]") == ["2"] and texts("//span[@id='s']") == ["2"]
    assert nodes.filter(M.attr_equals("class", "a b")).count() == 1 and nodes.filter(M.attr_has_word("class", "b")).count() == 1
    assert TR.run_path_rule(nodes, "page_id", "//div", delete=True).filter("tag = 'span'").count() == 1


def test_phrases_equal_brute_force(spark):
    import random

    r = random.Random(7)
    text = lambda n: " ".join("".join(r.choice("abé") for _ in range(r.randint(1, 5))) for _ in range(n))
    sentences = [text(12) + r.choice(["", "  x", "."]) for _ in range(200)]
    terms = {t for t in ([text(2) for _ in range(60)] + [text(3) for _ in range(20)] + ["a  b", " a", "b ", "aab", "A B"]) if t}
    got = X.match_phrases(spark.createDataFrame(list(enumerate(sentences)), "i int, sentence string"), spark.createDataFrame([("d", t) for t in terms], "dictionary string, term string"))
    assert sorted((x.i, x["match"]) for x in got.collect()) == sorted((i, t) for i, s in enumerate(sentences) for t in {t.lower() for t in terms} if t in s.lower())


def _joins(df):
    return [j for j in ("SortMergeJoin", "ShuffledHashJoin") if j in df._jdf.queryExecution().executedPlan().toString()]


def test_sentences_stay_where_they_are(spark):
    sentences = ["one of the few", "of these, none", "Of The one and of the other", "a b"]
    s = spark.createDataFrame(list(enumerate(sentences)), "i int, sentence string")
    for more in (0, 100):  # few terms are looked for directly, others by their anchors
        terms = ["of the", "the few", *[f"w{k} of" for k in range(more)]]
        got = X.match_phrases(s, spark.createDataFrame([("d", t) for t in terms], "dictionary string, term string"))
        assert not _joins(got)
        assert sorted((r.i, r["match"]) for r in got.collect()) == [(0, "of the"), (0, "the few"), (1, "of the"), (2, "of the")]


def test_words_stay_where_they_are(spark):
    words = spark.createDataFrame([(1, "The"), (1, "cat"), (2, "les"), (2, "the")], "i int, word string")
    terms = spark.createDataFrame([("en", "the"), ("fr", "Les"), ("en", "THE")], "dictionary string, term string")
    stop, hits = spark.createDataFrame([("the",)], "word string"), words.withColumnRenamed("word", "match")
    docs = spark.createDataFrame([(1, "The cat of the AB")], "doc_id int, text string")
    found = X.match_words(words, terms)
    for df in (found, X.keep_hits_in_dictionary(hits, terms), X.filter_words(words, stop=stop), X.search(docs, terms, {"caps": ("_ALLCAPS", "")})):
        assert not _joins(df)
    assert sorted((r.i, r.dictionary, r["match"]) for r in found.collect()) == [(1, "en", "the"), (2, "en", "the"), (2, "fr", "les")]


def test_snowball_needs_texts_only(spark):
    docs = spark.createDataFrame([("alpha beta beta Beta",), ("beta gamma gamma gamma the",), ("delta delta delta",), (None,), ("ALPHA alpha",)], "text string")
    got = X.snowball(docs, spark.createDataFrame([("Alpha",)], "term string"), rounds=2, least=2)
    assert sorted(map(tuple, got.collect())) == [("alpha", 0), ("beta", 1), ("gamma", 2)]


def test_keywords_count_words_with_phrases(spark):
    docs = spark.createDataFrame([("red fox jumps, the red fox",), ("Red fox. one two three four five six seven and fox",)], "text string")
    got = X.keywords(docs)
    # fox: 3 + 2 + 2 + 1 words in the phrases of its 4 uses; red: 3 + 2 + 2 in those of 3
    assert [tuple(r) for r in got.collect()] == [("red fox", 2, round(8 / 4 + 7 / 3, 6))]
    assert "RLIKE" not in got._jdf.queryExecution().optimizedPlan().toString().upper()  # no pattern is tried on each word


def test_lines_of_pages_that_span_batches(spark):
    spans = spark.createDataFrame([(p, k, 40 * k, 40 * k + 30, 5, 15, f"{p}{k}") for p in range(3) for k in range(5)] + [(None, 9, 0, 1, 0, 1, None), (1, 9, 0, 1, 90, 91, None)], "page int, span_id int, x0 int, x1 int, y0 int, y1 int, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = L.merge_lines(spans)
        assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()  # no page is one row
        rows = [tuple(r) for r in got.orderBy("page", "line").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    line = lambda p: (p, 0, 0, 190, 5, 15, " ".join(f"{p}{k}" for k in range(5)))
    assert rows == [(None, 0, 0, 1, 0, 1, None), line(0), line(1), (1, 1, 0, 1, 90, 91, None), line(2)]


def test_nfkd_holds_small_batches(spark, tmp_path):
    from folioscan.functions import text as T
    from folioscan.plans import queries, structure  # noqa: F401 - registers its queries

    texts = ["ﬁne café", None, "", "plain", "½ ™ Ω"] * 30
    v = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    assert [r.t for r in v.orderBy("doc_id").select(T.nfkd_ascii("text").alias("t")).collect()] == ["fine cafe", None, "", "plain", "12 TM "] * 30
    v.write.parquet(f"{tmp_path}/documents.parquet")
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "10000")
    try:
        assert queries.QUERIES["flatten_text_nfkd"](spark, str(tmp_path)).count() == 150
        assert int(spark.conf.get(names[0])) <= 512
    finally:
        for n in names:
            spark.conf.set(n, before[n])
