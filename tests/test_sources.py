"""Readers, writers, parsers and streams on small files."""
import pytest
from pyspark.sql import functions as F

from folioscan.sources import markup as M
from folioscan.sources import scan, sinks
from folioscan.streaming import hits


def test_schemes():
    scheme = {"_NOTE": "x", "ROOT": "base", "KIND": ["a", "b"], "SUB": ["1", "2"], "FILE": "*", "SUFFIX": "xml"}
    assert scan.expand_scheme(scheme) == [f"base/{k}/{s}/*.xml" for k in "ab" for s in "12"]
    with pytest.raises(ValueError):
        scan.expand_scheme({"ROOT": "_REQD"})
    with pytest.raises(ValueError):
        scan.register({"a": "x"}, "a", "y")
    with pytest.raises(ValueError):
        sinks.guarded("a/*")


def test_dictionary_round_trip(spark, tmp_path):
    entries = spark.createDataFrame([("Foo", "foo", "Q1"), ("Bar", "bar", None)], "term string, name string, wikidata_id string")
    sinks.write_dictionary(entries, str(tmp_path / "d"), "small")
    got = scan.read_dictionary(spark, str(tmp_path / "d"))
    assert sorted((r.term, r.wikidata_id) for r in got.collect()) == [("Bar", None), ("Foo", "Q1")]


def test_files(spark, tmp_path):
    root = tmp_path / "proj" / "PMC1" / "sections" / "0_front" / "1_article-meta"
    root.mkdir(parents=True)
    (root / "1_abstract.xml").write_text("<p>x</p>")
    (root.parent.parent.parent / "fulltext.xml").write_text("<a/>")
    (tmp_path / "proj" / "bad.txt").write_bytes(b"\xff\xfe")
    paths = scan.list_paths(spark, str(tmp_path / "proj"))
    assert paths.count() == 3
    assert [r.tree.rsplit("/", 1)[-1] for r in scan.trees(paths).collect()] == ["PMC1"]
    assert [r.section for r in scan.sections(paths, "abstract").collect()] == ["abstract"]
    loaded = {r.kind: r.text for r in scan.load_files(spark, str(tmp_path / "proj")).collect() if r.kind == "txt"}
    assert loaded == {"txt": None}
    (tmp_path / "s.txt").write_text("0: a b\n1: c: d\n3: e\n")
    rows = scan.read_numbered_sentences(spark, str(tmp_path / "s.txt"))
    assert [tuple(r) for r in rows.orderBy("n").collect()] == [(0, "a b"), (1, "c"), (3, "e")]
    assert [r.n for r in scan.out_of_order(rows.withColumn("doc", F.lit("d")), "doc").collect()] == [3]
    (tmp_path / "c.csv").write_text("keyword/phrase,score\na b,1\n,2\n")
    assert [r.term for r in scan.read_csv_terms(spark, str(tmp_path / "c.csv"), "keyword/phrase").collect()] == ["a b"]
    (tmp_path / "a.ini").write_text(f"[x]\none = 1\nnext_ini = {tmp_path}/b.ini\n")
    (tmp_path / "b.ini").write_text(f"[y]\none = 2\nback_ini = {tmp_path}/a.ini\n")
    assert scan.read_symbols(str(tmp_path / "a.ini"))["one"] == "2"


def test_section_kinds(spark):
    paths = ["t/sections/0_front/0_journal-meta/1_journal-id.xml", "t/sections/1_body/0_introduction/3_p.xml", "t/sections/1_body/4_p.xml", "t/sections/1_body/2_x/0_table-wrap/0_label.xml", "t/sections/1_body/2_x/0_table-wrap/1_table.xml",
             "t/sections/2_back/0_ref-list/0_ref.xml", "t/sections/2_back/0_ref-list/1_ref.xml", "t/sections/figures/figure_1.xml", "t/other/4_p.xml"]
    got = {}
    for r in scan.sections(spark.createDataFrame([(p,) for p in paths], "path string")).collect():
        got.setdefault(r.section, set()).add(r.path)
    assert got["xml"] == set(paths[:-1]) and got["journal"] == {paths[0]} and got["intro"] == {paths[1]} and got["para"] == {paths[1], paths[2]}
    assert got["table"] == {"t/sections/1_body/2_x/0_table-wrap"} and got["table_label"] == {paths[3]} and got["table_body"] == {paths[4]}
    assert got["ref-list"] == {"t/sections/2_back/0_ref-list"} and got["ref"] == {paths[5], paths[6]} and got["figure_old"] == {paths[7]} and "abstract" not in got


def test_html(spark):
    pages = spark.createDataFrame([(1, "<div id=a>x<p>one<p>two <b>bold<br></div>tail &amp; more</i>"), (2, None), (3, "")], "page_id int, html string")
    nodes = M.html_nodes(pages).cache()
    assert nodes.select("page_id").distinct().count() == 1
    assert [r.content for r in M.text_content(nodes, "page_id", "p").orderBy("ord").collect()] == ["one", "two bold"]
    assert [r.content for r in M.text_content(nodes, "page_id", "div").collect()] == ["xonetwo bold"]
    assert nodes.filter("tag = 'div'").first().attrs == {"id": "a"}
    assert M.same_tree(nodes, nodes)
    assert {r.tag for r in M.empty_elements(nodes, "page_id").collect()} == {"br"}


def test_sections(spark):
    xml = "<article><front><article-title>T</article-title></front><body><sec><title>Intro A</title><p>one</p><fig><label>1</label></fig></sec><disp-formula/></body></article>"
    rows = M.xml_sections(spark.createDataFrame([("d", xml), ("e", "<bad"), ("f", None)], "doc_id string, xml string")).orderBy("ord").collect()
    assert [r.path for r in rows] == ["sections/0_front/0_article-title", "sections/1_body/0_intro_a/0_title", "sections/1_body/0_intro_a/1_p", "sections/1_body/0_intro_a/2_fig", "sections/1_body/1_disp-formula"]
    with pytest.raises(Exception, match="well-formed"):
        M.xml_sections(spark.createDataFrame([("e", "<bad")], "doc_id string, xml string"), strict=True).collect()
    fig = spark.createDataFrame([("<fig><label>1</label><caption><p>cap</p></caption></fig>",)], "xml string").select(M.figure(F.col("xml")).alias("f")).first().f
    assert tuple(fig) == ("1", "cap", "")


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat"), (2, "a dog the end")], "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = hits.read_stream(spark, str(tmp_path / "in"), "doc_id int, text string")
    terms = spark.createDataFrame([("d", "the"), ("d", "dog")], "dictionary string, term string")
    q = hits.append_parquet(hits.match_stream(stream, terms, "doc_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted((r.doc_id, r["match"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "the"), (2, "dog"), (2, "the")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "b, c", "I. Intro!"), (0, "a", "intro")], "n int, text string, marker string")
    sinks.write_numbered(df, str(tmp_path / "n"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "n")).collect()) == ["0: a", "1: b, c"]
    sinks.write_csv(df.select("n", "text"), str(tmp_path / "c"))
    assert sorted(tuple(r) for r in spark.read.option("header", "true").csv(str(tmp_path / "c")).collect()) == [("0", "a"), ("1", "b, c")]
    sinks.write_lines(df, "n", str(tmp_path / "l"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "l")).collect()) == ["0", "1"]
    sinks.write_by_marker(df, str(tmp_path / "m"))
    assert len([p for p in (tmp_path / "m").iterdir() if p.name.startswith("marker=")]) == 2
    sections = M.xml_sections(spark.createDataFrame([("d", "<a><p>x</p></a>"), ("e", "<a><p>y</p><p>z</p></a>")], "doc_id string, xml string"))
    sinks.write_sections(sections, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).filter("doc_id = 'e'").count() == 2
    assert sinks.html_table(df.select("n", "marker").orderBy("n")) == '<table id="results"><thead><tr><th>n</th><th>marker</th></tr></thead><tbody><tr><td>0</td><td>intro</td></tr><tr><td>1</td><td>I. Intro!</td></tr></tbody></table>'
    names = sinks.tree_names(spark.createDataFrame([("x/a b.pdf",), ("y/a b.pdf",), ("z/c.pdf",)], "path string")).orderBy("path").collect()
    assert [r.tree for r in names] == ["a_b_1", "a_b_2", "c"]


def test_file_readers(spark, tmp_path):
    (tmp_path / "d.xml").write_text('<dictionary title="one" version="1.0.0"><entry term="A"/></dictionary>')
    assert [(r.title, r.version) for r in scan.read_header(spark, str(tmp_path / "d.xml")).collect()] == [("one", "1.0.0")]
    (tmp_path / "bad.xml").write_text('<dictionary version="1.0.0"><entry term="A"/></dictionary>')
    with pytest.raises(Exception, match="without title"):
        scan.read_header(spark, str(tmp_path / "bad.xml")).collect()
    (tmp_path / "r.xml").write_text('<sparql><results><result><binding name="i"><uri>http://x/Q1</uri></binding><binding name="l"><literal xml:lang="en">One</literal></binding></result></results></sparql>')
    assert [tuple(r)[1:] for r in scan.read_sparql_results(spark, str(tmp_path / "r.xml")).collect()] == [("i", "http://x/Q1", None), ("l", None, "One")]
    (tmp_path / "e.xml").write_text("<sparql><results></results></sparql>")
    with pytest.raises(ValueError):
        scan.read_sparql_results(spark, str(tmp_path / "e.xml"))
    (tmp_path / "w.txt").write_text("one\n\n two \n")
    assert [r.term for r in scan.read_terms(spark, str(tmp_path / "w.txt")).collect()] == ["one", "two"]
    (tmp_path / "c.csv").write_text("a,b\n1,x\n2,y\n3,x\n")
    assert [r.a for r in scan.select_csv(spark, str(tmp_path / "c.csv"), "a", "b", "x").collect()] == ["1", "3"]
    (tmp_path / "l.txt").write_text("{'a': 1, 'b': ['x',],}")
    assert scan.read_literal(str(tmp_path / "l.txt")) == {"a": 1, "b": ["x"]}
    (tmp_path / "p.json").write_text('{"pages": [{"page_number": 1, "width": 10, "height": 20, "chars": [{"text": "a", "x0": 1}, {"text": "b", "x0": 2}]}]}')
    assert [(r.page, r.pos, r.text, r.x0) for r in scan.read_pages_json(spark, str(tmp_path / "p.json")).collect()] == [(1, 0, "a", 1.0), (1, 1, "b", 2.0)]
    tops = scan.page_tops(spark.createDataFrame([("d", 1, 100.0), ("d", 2, 80.0), ("d", 3, 10.0)], "doc_id string, page int, height double"))
    assert [r.top for r in tops.orderBy("page").collect()] == [0.0, 150.0, 280.0]
    paths = spark.createDataFrame([("p/t/fulltext.txt",), ("p/t/x.xml",), ("p/t/svg/a.svg",)], "path string")
    assert [r.path for r in scan.children(paths, "p/t", "x").collect()] == ["p/t/x.xml"]
    names = spark.createDataFrame([("fulltext.xml",), ("_x",), ("a.count.xml",), ("svg",), ("other.txt",)], "name string")
    assert [r[0] for r in names.select(scan.is_reserved(F.col("name"))).collect()] == [True, True, True, True, False]
    tree = tmp_path / "proj" / "T1"
    tree.mkdir(parents=True)
    (tree / "fulltext.raw.txt").write_text("body")
    (tree / "other.txt").write_text("no")
    assert [r.text for r in scan.fulltexts(spark, str(tmp_path / "proj")).collect()] == ["body"]


def test_svg(spark):
    head = '<svg xmlns="http://www.w3.org/2000/svg" xmlns:svgx="http://www.xml-cml.org/schema/svgx">'
    text = lambda x, y, more="", t="a": f'<text x="{x}" svgx:width="0.5" y="{y}" style="font-size:10px;font-family:F;stroke:none" fill="red" {more}>{t}</text>'
    svg = head + text("100,110", 100) + text("90", 100, t="b") + text("80", 90, t="c") + text("80", 20) + text("5", 100) + text("80", 95, 'rotateDegrees="90"', "r") + text("80", 99, t="  ") + text("x", 1) + "</svg>"
    pages = spark.createDataFrame([(1, svg), (2, "<bad"), (3, None)], "page int, svg string")
    rows = M.svg_spans(pages, "page").orderBy("at").collect()
    assert [(r.text, r.x, r.end_x, r.x1, r.y0, r.y1) for r in rows] == [("c", 80, 80, 85, 80, 90), ("b", 90, 90, 95, 90, 100), ("a", 100, 110, 115, 90, 100)]
    assert (rows[0].family, rows[0].fill, rows[0].stroke, rows[0].weight, rows[0].last_width) == ("F", "red", "none", None, 0.5)
    assert [r.text for r in M.svg_spans(pages, "page", rotated=True).orderBy("at").collect()] == ["c", "r", "b", "a"]


def test_tidy_and_lines(spark):
    from folioscan.operators import layout as L

    chars = spark.createDataFrame([("k", 0, 0.0, 5.0), ("k", 1, 5.0, 10.0), ("k", 2, 60.0, 65.0)], "k string, pos int, x0 double, x1 double").withColumns({"width": F.lit(0.5), "size": F.lit(10.0)})
    assert [r.pos for r in L.word_breaks(chars, ["k"]).collect()] == [1]
    spans = spark.createDataFrame([(1, 10.0, 20.0), (1, 100.0, 110.0), (1, 280.0, 295.0)], "page int, y0 double, y1 double")
    assert [r.y0 for r in L.page_frame(spans, 50, 20, 300).collect()] == [100.0]


def test_only_named_entities_are_decoded():
    text = '<title>a &quot;b&quot; &lt;c&gt; &amp;lt; d&amp</title><!-- <script> & --><p id="x&quot;&amp;">e &eacute; &</p><script>a && b &amp; c</script>'
    some, every = ([(r[5], r[6], r[7]) for r in M.parse_html(text, e)] for e in (("lt", "gt", "amp"), None))
    assert [t for _, t, _ in some if t] == ["a &quot;b&quot; <c> &lt; d&amp", "e &eacute; &", "a && b &amp; c"]
    assert [t for _, t, _ in every if t] == ['a "b" <c> &lt; d&', "e é &", "a && b &amp; c"]
    assert some[2][2] == {"id": "x&quot;&"} and every[2][2] == {"id": 'x"&'}
