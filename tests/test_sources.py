from __future__ import annotations

import pytest
from corpusloom import schemas
from corpusloom.functions import text as tx
from corpusloom.functions import urls
from corpusloom.operators import code, convert, routing, summaries
from corpusloom.options import Options
from corpusloom.sources import files, graphfiles, sinks, sitemap
from pyspark.sql import functions as F

HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def test_routing(spark, rows):
    items = [
        ("docs/A.PDF", "file", "pdf"),
        ("https://x.org/a.pdf", "url", "url"),
        ("https://github.com/u/r", "url", "git"),
        ("https://github.com/u/r.js", "url", "git"),
        ("https://gitlab.com/u/r", "url", "git"),
        ("git@github.com:u/r.git", "file", "git"),
        ("https://x.org/sitemap.xml", "url", "url"),
        ("notes.txt", "file", None),
    ]
    df = spark.createDataFrame([i[:2] for i in items], schemas.MANIFEST)
    routed = routing.default_registry().route(df)
    assert rows(routed) == sorted(items, key=repr)
    kinds = df.select("item", routing.kind_of(F.col("item")))
    assert rows(kinds) == rows(df)


def test_registry_order_and_replacement(spark, rows):
    df = spark.createDataFrame([("a.pdf", "file"), ("b.txt", "file")], schemas.MANIFEST)

    def read(item, options):
        return routing.result_row(item, F.array(item), F.create_map(F.lit("file_type"), F.lit("pdf")))

    expected = [("a.pdf", True, None), ("b.txt", False, "No processor found for b.txt")]
    by_row = routing.default_registry().replace("pdf", row=read)
    by_table = routing.default_registry().replace(
        "pdf", table=lambda items, options: routing.as_results(items, read(F.col("item"), options))
    )
    for registry in (by_row, by_table):
        done = registry.process(df, Options())
        assert rows(done, "item", "success", "error") == expected
        assert {r.metadata.get("file_type") for r in done.collect()} == {"pdf", None}
    first = routing.Registry().register("any", lambda i, k: F.lit(True), routing.url_result)
    first.register("pdf", routing.takes_pdf, routing.pdf_result)
    assert {r.source_type for r in first.route(df).collect()} == {"any"}
    with pytest.raises(ValueError):
        first.register("none", routing.takes_pdf)


def test_git_urls(spark):
    cases = {
        "https://github.com/u/r": True,
        "http://github.com/u/r.git/": True,
        "https://github.com/u/r.js": False,
        "https://github.com/u/r/blob/main/x.py": False,
        "https://gitlab.com/u/r": False,
        "git@github.com:u/r.git": True,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u STRING")
    got = {r[0]: r[1] for r in df.select("u", urls.git_url_valid(F.col("u"))).collect()}
    assert got == cases


def test_sitemap_flag_and_addresses(spark):
    df = spark.createDataFrame([("https://x.org/sitemap.xml",)], "i STRING")
    for flag in (True, False):
        assert df.select(routing.is_sitemap(F.col("i"), Options(sitemap_only=flag))).first()[0] is flag
    cases = {
        "https://x.org": "https://x.org/sitemap.xml",
        "https://x.org/": "https://x.org/sitemap.xml",
        "https://x.org/a/b": "https://x.org/a/sitemap.xml",
        "https://x.org/a/b/?q=1#t": "https://x.org/a/b/sitemap.xml",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u STRING")
    got = {r[0]: r[1] for r in df.select("u", urls.sitemap_address(F.col("u"))).collect()}
    assert got == cases


def test_names(spark):
    cases = {
        "a/b.tar.gz": (".gz", "b.tar"),
        "a/.hidden": ("", ".hidden"),
        "a/plain": ("", "plain"),
        "img.PNG": (".PNG", "img"),
    }
    df = spark.createDataFrame([(p,) for p in cases], "p STRING")
    got = {r[0]: (r[1], r[2]) for r in df.select("p", tx.suffix(F.col("p")), tx.stem(F.col("p"))).collect()}
    assert got == cases
    one = spark.createDataFrame([("x/Täst file-1.md",)], "p STRING").select(
        tx.export_name(F.col("p"), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    )
    assert one.first()[0] == "Täst_file_1_20240102_030405.json"


def test_processable_files(spark, rows):
    long_text = "x" * 8191 + "é" + "y" * 10
    cases = [
        (".git/config", b"x", False),
        ("a/node_modules/a.js", b"x", False),
        (".github/ci.yml", b"x", False),
        (".gitignore", b"x", True),
        ("a.tar.gz", b"x", False),
        ("img.PNG", b"x", False),
        ("ok.txt", "héllo".encode(), True),
        ("bad.txt", b"\xff\xfe", False),
        ("cut.txt", long_text.encode(), True),
        ("late.txt", b"x" * 9000 + b"\xff", True),
        ("early.txt", b"x" * 5000 + b"\xff" + b"x" * 5000, False),
        ("edge.txt", b"x" * 8191 + b"\xff" + b"x", False),
        ("short_cut.txt", b"x" * 10 + b"\xc3", False),
        ("long_cut.txt", b"x" * 2000 + b"\xe2\x82", True),
        ("empty", b"", True),
    ]
    df = spark.createDataFrame([("r", p, bytearray(c)) for p, c, _ in cases], schemas.FILES)
    kept = {r.path for r in routing.processable_files(df).collect()}
    assert kept == {p for p, _, keep in cases if keep}
    assert rows(summaries.counts_by(df, "repo", "file_count")) == [("r", len(cases))]


def test_scan_and_invalid_paths(spark, rows, tmp_path):
    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/a.txt").write_text("a")
    (tmp_path / "d/e/b.py").write_text("def f():\n    return 1\n")
    (tmp_path / "d/e/.git").mkdir()
    (tmp_path / "d/e/.git/config").write_text("x")
    (tmp_path / "d/__init__.py").write_text("")
    visible = [("d/a.txt", 1), ("d/e/b.py", 22)]
    assert rows(files.scan(spark, str(tmp_path)), "path", "length") == visible
    found = files.scan_tree(spark, str(tmp_path))
    assert rows(found, "path", "length") == sorted(visible + [("d/e/.git/config", 1), ("d/__init__.py", 0)], key=repr)
    wanted = spark.createDataFrame([("d/a.txt",), ("d/e/",), ("nope.txt",), ("https://x.org",)], "item STRING")
    assert rows(files.invalid_paths(wanted, found), "item", "error") == [
        ("nope.txt", "Invalid input path: nope.txt")
    ]
    assert rows(files.input_manifest(wanted, found)) == [
        ("d/a.txt", "file"),
        ("d/e/.git/config", "file"),
        ("d/e/b.py", "file"),
        ("https://x.org", "url"),
    ]
    tree = files.repository_files(spark, str(tmp_path))
    assert rows(tree, "path") == [("d/__init__.py",), ("d/a.txt",), ("d/e/b.py",)]
    blocks = code.file_chunks(files.code_files(tree))
    assert rows(blocks, "path", "type", "text") == [
        ("d/a.txt", "document_chunk", "a"),
        ("d/e/b.py", "function_definition", "def f():\n    return 1"),
    ]
    results = files.repository_results("https://github.com/u/r", tree)
    assert [r.success for r in results.collect()] == [True, True, True]


def _urlset(*locs, space=NS):
    return f"{HEAD}<urlset {space}>" + "".join(f"<url><loc>{u}</loc></url>" for u in locs) + "</urlset>"


def _index(*locs):
    return f"{HEAD}<sitemapindex {NS}>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in locs) + "</sitemapindex>"


def _maps(spark):
    image = 'xmlns:image="http://www.google.com/schemas/sitemap-image/1.1"'
    docs = [
        ("http://a/sitemap.xml", _urlset("http://a/1", "", "http://a/2")),
        ("http://p/sitemap.xml", _urlset("http://p/1", space="").replace("<urlset >", "<urlset>")),
        ("http://bad/sitemap.xml", "<urlset><url>"),
        ("http://img/sitemap.xml",
         f"{HEAD}<urlset {NS} {image}><url><loc>http://img/1</loc><image:image><image:loc>http://img/x.png"
         "</image:loc></image:image></url></urlset>"),
        ("http://root/sitemap.xml", _index("http://a/sitemap.xml", "http://mid/sitemap.xml", "http://gone/sitemap.xml")),
        ("http://mid/sitemap.xml", _index("http://a/sitemap.xml", "http://root/sitemap.xml", "http://p/sitemap.xml")),
    ]
    return spark.createDataFrame(docs, schemas.SITEMAPS)


def test_sitemap_flat(spark, rows):
    sites = spark.createDataFrame(
        [("http://a/",), ("http://p/",), ("http://bad/",), ("http://img/",), ("http://none//",)], "base_url STRING"
    )
    assert rows(sitemap.flat(sites, _maps(spark))) == [
        ("http://a/", 0, "http://a/1", None),
        ("http://a/", 1, "http://a/2", None),
        ("http://bad/", None, None, "Failed to parse sitemap XML"),
        ("http://img/", 0, "http://img/1", None),
        ("http://none//", 0, "http://none", None),
        ("http://p/", 0, "http://p/1", None),
    ]


def test_sitemap_recursive(spark, rows):
    roots = spark.createDataFrame(
        [("http://root/sitemap.xml",), ("http://bad/sitemap.xml",), ("http://p/sitemap.xml",)], "sitemap_url STRING"
    )
    found = sitemap.recursive(roots, _maps(spark))
    ordered = [r.url for r in found.orderBy("pos").collect()]
    # The same sitemap under two parents lists its pages twice; the cycle is not entered.
    assert ordered == ["http://a/1", "http://a/2", "http://a/1", "http://a/2"]
    assert rows(sitemap.sitemap_counts(found)) == [("http://root/sitemap.xml", 4, 1)]
    pages = spark.createDataFrame([("http://a/2", "<p>two</p>")], "url STRING, html STRING")
    docs = convert.sitemap_documents(found, pages)
    assert [r.document for r in docs.collect()] == ["two", "two"]


def test_html_entities_and_links(spark):
    page = (
        "<p>&middot; &copy; &amp;lt; &#233;&#x1F600; &#0; &nosuch; caf&eacute; a&nbsp;b</p>"
        "<a class=k href='/one'>1</a> <a href=/two>2</a> <a data-href='/no' href=\"/three\">3</a>"
    )
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id INT, html STRING")
    doc = {r.page_id: r.doc for r in convert.html_struct(df).collect()}
    assert doc[1].paragraphs == ["· © &lt; é😀 \ufffd &nosuch; café a b"]
    assert doc[1].links == ["/one", "/two", "/three"]
    text = {r.page_id: r.markdown for r in convert.html_markdown(df).collect()}
    assert text[1].endswith("[1](/one) [2](/two) [3](/three)") and text[2] is None and text[3] == ""


def test_html(spark):
    page = (
        '<html><head><title> T &amp; U </title></head><body><!-- no --><script>var a="</p>";</script>'
        '<h2 class="x">Head</h2><p>One <b>two</b><br>three</p><ul><li><a href="/u">link</a></li></ul></body></html>'
    )
    df = spark.createDataFrame([(1, "u", page)], "page_id INT, url STRING, html STRING")
    assert convert.html_markdown(df).first().markdown == "## Head\n\nOne **two**\nthree\n\n- [link](/u)"
    doc = convert.html_struct(df).first().doc
    assert (doc.title, doc.headings, doc.paragraphs, doc.links) == ("T & U", ["Head"], ["One two three"], ["/u"])
    assert convert.converted(df, ["page_id"], "xml").first().document is None


GRAPHML = """<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
  <key id="d0" for="node" attr.name="entity_type" attr.type="string" />
  <key id="d1" for="node" attr.name="description" attr.type="string" />
  <key id="d2" for="node" attr.name="source_id" attr.type="string" />
  <key id="d3" for="edge" attr.name="weight" attr.type="double" />
  <key id="d4" for="edge" attr.name="keywords" attr.type="string" />
  <graph edgedefault="undirected">
    <node id="A"><data key="d0">person</data><data key="d1">first &amp; best</data><data key="d2">c1</data></node>
    <node id="B"><data key="d0">place</data></node>
    <edge source="A" target="B"><data key="d3">2.5</data><data key="d4">located,in</data></edge>
  </graph>
</graphml>
"""


def test_graphml_and_json(spark, rows, tmp_path):
    path = tmp_path / "g.graphml"
    path.write_text(GRAPHML)
    nodes, edges = graphfiles.read_graphml(spark, str(path))
    assert rows(nodes) == [("A", "person", "first & best", "c1"), ("B", "place", None, None)]
    assert rows(edges) == [("A", "B", 2.5, None, "located,in", None)]
    out = str(tmp_path / "export")
    assert rows(sinks.write_graph(nodes, edges, out, dry_run=True)) == [("edges", 1), ("nodes", 2)]
    assert not graphfiles.path_exists(spark, out)
    sinks.write_graph(nodes, edges, out)
    again = graphfiles.load_graph(spark, "missing.graphml", out, skip_conversion=True)
    assert rows(again[0]) == rows(nodes) and rows(again[1]) == rows(edges)
    (tmp_path / "one.json").write_text('{"nodes": [{"id": "A", "entity_type": "x"}]}')
    nodes, edges = graphfiles.read_graph_json(spark, str(tmp_path / "one.json"))
    assert rows(nodes, "id", "entity_type") == [("A", "x")] and edges.count() == 0


def test_graph_export_batches(spark, rows, tmp_path):
    nodes = spark.range(1200).select(
        F.col("id").cast("string").alias("id"), F.lit("t").alias("entity_type"),
        F.lit("d").alias("description"), F.lit("s").alias("source_id"),
    ).coalesce(1)
    edges = spark.createDataFrame([("1", "2", 1.0, "d", "uses it", "s"), ("1", "nope", 1.0, "d", "k", "s")], schemas.EDGES)
    out = str(tmp_path / "graph")
    assert rows(sinks.write_graph_batches(nodes, edges, out)) == [("edges", 1), ("nodes", 1200)]
    assert len(list((tmp_path / "graph/nodes").glob("*.parquet"))) == 3
    assert spark.read.parquet(out + "/edges").first().rel_type == "uses"
    sinks.clear_graph(spark, nodes, edges, out)
    cleared = spark.read.parquet(out + "/nodes")
    assert cleared.count() == 0 and cleared.columns == nodes.columns


def test_documents_and_chunk_files(spark, tmp_path):
    docs = spark.createDataFrame([("a", "# A"), ("b", "# B")], "url STRING, document STRING")
    sinks.write_documents(docs, str(tmp_path / "md"), "markdown")
    sinks.write_documents(docs, str(tmp_path / "js"), "json")
    assert {r.value for r in spark.read.text(str(tmp_path / "md")).collect()} == {"# A", "# B"}
    assert {r.document for r in spark.read.json(str(tmp_path / "js")).collect()} == {"# A", "# B"}
