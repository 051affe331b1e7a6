"""Operators on small frames: hazards, sinks, streams, registries."""

from pyspark.sql import functions as F

from textloom.operators import facets, frontmatter, graph, pages, plugins, reader, related, tables, tfidf, vocab, works
from textloom.sources import readers, sinks
from textloom.streaming import incremental


def test_single_document_has_no_keywords(spark):
    docs = spark.createDataFrame([(1, "reason reason pure")], "k int, t string")
    assert tfidf.keywords(docs, "k", "t").count() == 0


def test_prototype_names_are_terms(spark):
    docs = spark.createDataFrame([(1, "constructor pure"), (2, "tostring pure")], "k int, t string")
    assert {r["term"] for r in tfidf.keywords(docs, "k", "t").collect()} == {"constructor", "tostring"}


def test_surfaces(spark):
    texts = spark.createDataFrame([(1, "Unvernunft und Vernunft"), (2, "eternal recurrence of hume"), (3, "Hume's recurrence")], "k int, t string")
    surfaces = spark.createDataFrame([("Vernunft", "v", False), ("eternal recurrence", "er", False), ("recurrence", "r", False), ("hume", "h", True)], "surface string, id string, cap boolean")
    got = sorted((r["k"], r["id"]) for r in vocab.mentions(texts, "k", "t", surfaces).collect())
    assert got == [(1, "v"), (2, "er"), (3, "h"), (3, "r")]
    words = sorted((r["k"], r["id"]) for r in vocab.mentions_by_words(texts, "k", "t", surfaces).collect())
    assert set(got) <= set(words)


def test_large_vocabularies_match_by_the_same_rule(spark, monkeypatch):
    texts = [(1, "Of the one and the many in a world of things, O'Neill's U.S. view: eternal recurrence"), (2, "a.b c.d, .net x.net (.net) c++"), (3, "one two three four"), (3, "two three"), (4, None), (5, "Hume hume-like HUME\nof  mind of mind")]
    surfaces = [("the one and the many in a world of things", "long", False), ("world of things", "inner", False), ("O'Neill", "n", True), ("u.s.", "us", False), ("recurrence", "r", False), ("eternal recurrence", "er", False), ("c.d", "cd", False), (".net", "net", False), ("c++", "cpp", False), ("one two", "a", False), ("two three four", "b", False), ("three", "c", False), ("four", "d", False), ("two three", "e", False), ("hume", "h", True), ("of mind", "m", None), ("Of Mind", "m2", False)]
    texts = spark.createDataFrame(texts, "k int, t string")
    surfaces = spark.createDataFrame(surfaces, "surface string, id string, cap boolean")
    key = lambda df: sorted((r["k"], r["id"], r["first_pos"]) for r in df.collect())
    small = key(vocab.mentions(texts, "k", "t", surfaces))
    monkeypatch.setattr(vocab, "PATTERN_LIMIT", 3)
    assert key(vocab.mentions(texts, "k", "t", surfaces)) == small
    assert {"long", "n", "us", "er", "cd", "net", "cpp", "a", "c", "e", "h", "m", "m2"} <= {i for _, i, _ in small} and "inner" not in {i for _, i, _ in small}


def test_df_cap(spark):
    tags = spark.createDataFrame([(w, "full") for w in range(80)] + [(w, "over") for w in range(81)], "w int, t string")
    assert {r["t"] for r in related.weighted(tags, "w", "t").select("t").distinct().collect()} == {"full"}


def test_related_never_names_itself_nor_its_own_position(spark):
    tags = spark.createDataFrame([(w, t) for w in range(6) for t in ("a", "b", "c") if (w + ord(t)) % 2], "w int, t string")
    atoms = tags.select(F.col("w").alias("atom"), "w", "t")
    assert related.affinity(atoms, tags, "atom", "w", "t").where("atom = other").count() == 0
    opp = spark.createDataFrame([("a", "b")], "t string, against string")
    got = related.contrast(atoms, tags, opp, "atom", "w", "t")
    mine = tags.select(F.col("w").alias("other"), "t")
    assert got.join(mine, ["other", "t"], "left_semi").count() == 0


def test_labels_pad_and_number(spark):
    atoms = spark.createDataFrame([("w", "A", 1), ("w", "A", 2), ("w", "", 1234), ("w", "B ", 1235)], "work string, title string, n int").withColumn("wt", F.lit("Work"))
    got = {r["n"]: (r["atom_id"], r["label"]) for r in works.labelled(atoms, "work", "title", "n", "wt").collect()}
    assert got == {1: ("001", "Work"), 2: ("002", "A (2/2)"), 1234: ("1234", "Parte 1234"), 1235: ("1235", "B")}


def test_facets(spark):
    df = spark.createDataFrame([(1, "x", ["p", "q"]), (2, "y", ["q"]), (3, None, [])], "id int, s string, m array<string>")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(facets.matching(df, ["s::x", "s::y", "m::q"])) == [1, 2]
    assert ids(facets.matching(df, ["s::y", "m::p"], "anytag")) == [1, 2]
    assert ids(facets.matching(df, [])) == []
    assert {(r["facet"], r["value"], r["n"]) for r in facets.counts(df, ["s", "m"]).collect()} == {("s", "x", 1), ("s", "y", 1), ("m", "p", 1), ("m", "q", 2)}
    assert facets.parse_token("a::b::c") == ("a", "b::c")
    assert facets.toggled({"a"}, "a") == set()


def test_pages_partition_the_rows(spark):
    df = spark.createDataFrame([(i, float(i % 3) if i % 4 else None, f"n{i}") for i in range(10)], "id int, v double, name string")
    keys = tables.sort_keys(df, "v", True, "name")
    got = [r["id"] for p in (1, 2, 3) for r in tables.page(df, keys, p, 4).orderBy("rank").collect()]
    assert sorted(got) == list(range(10))
    assert [r["v"] for r in tables.page(df, keys, 9, 4).collect()][-1] is None
    assert tables.pager(5, 10) == [1, None, 3, 4, 5, 6, 7, None, 10]
    assert tables.range_text(10, 3, 4) == "9-10 / 10"


def test_frontmatter_round(spark):
    raw = "---\nk: [a, b]\nn: -1.5\nempty:\ns: \"q\"\n---\nx\ny"
    r = frontmatter.parsed(spark.createDataFrame([(raw,), ("plain",)], "raw string")).collect()
    assert r[0]["content"] == "x\ny" and r[0]["data"]["k"]["items"] == ["a", "b"] and r[0]["data"]["empty"]["items"] == [] and r[0]["data"]["n"]["scalar"] == "-1.5" and r[0]["data"]["s"]["scalar"] == "q"
    assert r[1]["data"] == {} and r[1]["content"] == "plain"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "n" / "a").mkdir(parents=True)
    (tmp_path / "n" / "a" / "x.md").write_text("---\ntitle: X\n---\nbody")
    (tmp_path / "n" / "a" / "x.it.md").write_text("corpo")
    (tmp_path / "n" / "a" / "skip.txt").write_text("no")
    got = readers.notes(spark, str(tmp_path / "n"), translations=False).collect()
    assert [(r["name"], r["parent"], r["raw"]) for r in got] == [("x", "a", "---\ntitle: X\n---\nbody")]
    assert readers.notes(spark, str(tmp_path / "missing")).count() == 0
    assert readers.optional_json(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "v.json").write_text('{"axes": [{"id": "god", "label": "God"}], "forms": [{"id": "f"}]}')
    nodes = readers.vocabulary(spark, str(tmp_path / "v.json"), {"axes": "axis", "forms": "form", "schools": "school"})
    assert {(r["id"], r["type"]) for r in nodes.collect()} == {("god", "axis"), ("f", "form")}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "Kant.json").write_text('{"critique": {"axes": ["god"], "forms": []}}')
    r = readers.keyed_json(spark, str(tmp_path / "t")).collect()
    assert (r[0]["key"], r[0]["entry"], r[0]["value"]["axes"]) == ("Kant", "critique", ["god"])
    (tmp_path / "c.json").write_text('{"content": {"p": {"title": "P", "tags": [], "links": ["a"], "content": "text"}}}')
    assert readers.content_index(spark, str(tmp_path / "c.json")).first()["slug"] == "p"
    df = spark.createDataFrame([("k1", 1), ("k2", 2)], "key string, v int")
    assert [r["key"] for r in sinks.sharded(df, str(tmp_path / "s"), "key").collect()] == ["k1", "k2"]
    assert readers.shard(spark, str(tmp_path / "s"), "key", "k2").first()["v"] == 2
    assert readers.shard(spark, str(tmp_path / "s"), "key", "zz").count() == 0
    notes = spark.createDataFrame([("d", 'A "b"', ["x"], "body")], "dir string, title string, tags array<string>, body string")
    block = notes.select(sinks.frontmatter_block(notes, ["title", "tags"]).alias("b")).first()["b"]
    assert block == '---\ntitle: "A \\"b\\""\ntags:\n  - "x"\n---\n'
    sinks.markdown(notes, str(tmp_path / "md"), "dir", ["title", "tags"], "body")
    assert spark.read.text(str(tmp_path / "md"), wholetext=True).first()["value"].startswith(block + "body")


def test_glob_pattern():
    import re

    p = readers.glob_pattern("private/**/*.md")
    assert re.match(p, "private/a/b.md") and re.match(p, "private/b.md") and not re.match(p, "public/b.md")


def test_reader(spark):
    df = spark.createDataFrame([(1, i, m) for i, m in enumerate([0, 1, 0, 0, 1, 0])], "d int, p int, m int")
    assert [r["segment"] for r in reader.segments(df, "d", "p", F.col("m") == 1).orderBy("p").collect()] == [1, 1, 1, 2, 2]
    ids = spark.createDataFrame([("w", "001", 1), ("w", "002--a", 2)], "w string, id string, o int")
    pick = lambda x: reader.fragment(ids, "w", "id", "o", F.lit(x)).first()["id"]
    assert [pick("002--a"), pick("002"), pick("zz")] == ["002--a", "002--a", "001"]


def test_trie(spark):
    pg = spark.createDataFrame([("index",), ("folder/subfolder/test",), ("abc/index",)], "slug string")
    nodes = graph.trie(pg, "slug")
    assert {r["folder"] for r in graph.folder_paths(nodes).collect()} == {"index", "folder/index", "folder/subfolder/index", "abc/index"}
    order = [r["path"] for r in graph.pre_order(nodes).collect()]
    assert order.index("folder") < order.index("folder/subfolder") < order.index("folder/subfolder/test")
    assert not nodes.where("path = 'folder'").first()["has_data"]


def test_transclusion(spark):
    pg = spark.createDataFrame([("a/b",), ("c.canvas",)], "slug string")
    refs = spark.createDataFrame([("a/b",), ("c",), ("c.x",), ("zz",)], "ref string")
    got = {r["ref"]: r["target"] for r in graph.transclusion_targets(refs, "ref", pg, "slug").collect()}
    assert got == {"a/b": "a/b", "c": "c.canvas", "c.x": "c.canvas", "zz": None}


def test_matchers_and_conditions(spark):
    df = spark.createDataFrame([("index", ["t"], {"k": "v"}), ("tags/x.md", [], {})], "slug string, tags array<string>, data map<string,string>")
    assert df.where(pages.every(pages.slug_prefix("tags/"), pages.ext(".md"))).count() == 1
    assert df.where(pages.frontmatter("k", lambda c: c == "v")).count() == 1
    assert df.where(pages.condition("has-tags")).count() == 1
    pages.register("never", pages.nothing)
    assert df.where(pages.condition("never")).count() == 0
    kept, dropped = pages.published(df, [pages.condition("not-index")])
    assert (kept.count(), dropped.count()) == (1, 1)


def test_registry(spark):
    reg = plugins.Registry()
    reg.add(plugins.Plugin("second", 60, transform=lambda d: d.withColumn("v", F.col("v") * 2)))
    reg.add(plugins.Plugin("first", 10, transform=lambda d: d.withColumn("v", F.col("v") + 1)))
    reg.add(plugins.Plugin("keep", keep=lambda: F.col("v") > 3))
    reg.add(plugins.Plugin("out", emit=lambda d: d.select("v")))
    assert [r["v"] for r in reg.run(spark.createDataFrame([(0,), (1,)], "v int"))["out"].collect()] == [4]
    assert reg.counts() == {"transformer": 2, "filter": 1, "emitter": 1, "pageType": 0}
    assert plugins.set_option({"a": {"b": 1}}, "a.c=[2]") == {"a": {"b": 1, "c": [2]}}
    assert plugins.set_option({}, "x=plain") == {"x": "plain"}


def test_stream_follows_changes(spark, tmp_path):
    schema = "path string, seq long, kind string, body string"
    log = tmp_path / "log"
    spark.createDataFrame([("a", 1, "add", "1"), ("b", 2, "add", "2"), ("a", 3, "change", "3")], schema).coalesce(1).write.parquet(str(log))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(log))
        incremental.follow(stream, str(tmp_path / "state"), "path", "seq", "kind", ["body"], str(tmp_path / "cp")).awaitTermination()
        return {r["path"]: r["body"] for r in incremental.latest(spark, str(tmp_path / "state")).collect()}

    assert run() == {"a": "3", "b": "2"}
    spark.createDataFrame([("b", 4, "delete", None), ("c", 5, "add", "5")], schema).coalesce(1).write.mode("append").parquet(str(log))
    assert run() == {"a": "3", "c": "5"}
    assert [r["path"] for r in incremental.tombstones(spark.read.parquet(str(log)), "path", "seq", "kind").collect()] == ["b"]


def test_stream_rewrites_touched_parts_only(spark, tmp_path):
    """Parts without a change stay, an emptied part goes, superseded ones are deleted, a batch run again changes nothing."""
    log, state = tmp_path / "log", str(tmp_path / "state")
    schema = "path string, seq int, kind string, body string"
    told = []

    def run(rows, cp="cp"):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(log))
        stream = spark.readStream.schema(schema).parquet(str(log))
        incremental.follow(stream, state, "path", "seq", "kind", ["body"], str(tmp_path / cp), lambda c, n: told.append((n, c.count())), buckets=8).awaitTermination()
        return {r["path"]: r["body"] for r in incremental.latest(spark, state).collect()}

    parts = lambda: {(int(p.parent.name[2:]), int(p.name[7:])) for p in (tmp_path / "state/data").glob("v=*/bucket=*")}
    body = {f"k{i}": str(i) for i in range(40)}
    assert run([(k, 1, "add", v) for k, v in body.items()]) == body
    first = parts()
    assert run([("k3", 2, "change", None)]) == body | {"k3": None}
    assert len(parts() - first) == 1
    assert run([(k, 3, "delete", None) for k in body]) == {}
    assert run([("new", 4, "add", "x")]) == {"new": "x"}
    assert {v for v, _ in parts()} == {3} and [n for n, _ in told] == [0, 1, 2, 3]
    assert run([]) == {"new": "x"}
    assert incremental.latest(spark, str(tmp_path / "none")) is None
    import shutil

    shutil.rmtree(tmp_path / "state/manifest/v=3")  # as if the last batch had been lost before its manifest
    assert incremental.latest(spark, state).count() == 0
    (tmp_path / "cp/commits/3").unlink()
    (tmp_path / "cp/commits/.3.crc").unlink(missing_ok=True)
    assert run([]) == {"new": "x"}


def test_rewrite_keeps_order(spark):
    notes = spark.createDataFrame([(1, "a [[x]] b [[y|Y]] c")], "k int, t string")
    targets = spark.createDataFrame([("x", "h/x", "X", 1)], "target string, href string, title string, priority int")
    assert vocab.rewritten(notes, "k", "t", targets).first()["t"] == "a [X](/h/x) b Y c"


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "tfidf_topk" in e.queries()


def test_long_chains_and_cycles(spark):
    """Frontiers have no depth limit, visit a node once and end in cycles."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(30, 20), (3, 3), (5, 7)], "src long, dst long")
    roots = spark.createDataFrame([(0,), (29,)], "r long")
    got = {(r["root"], r["node"]) for r in graph.closure(chain, roots).collect()}
    assert got == {(0, i) for i in range(31)} | {(29, i) for i in range(20, 31)}
    cycles = {r["node"]: r["cycle"] for r in graph.cycles(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "a"), ("b", "a")], "src string, dst string")).collect()}
    assert cycles == {"a": "a>b>a", "b": "b>a>b", "c": "c>a>b>c", "d": "d>d"}


def test_rows_without_a_bag_never_match(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    bag = spark.createDataFrame([(1, "the tree"), (2, None)], "k int, words string")
    assert [r["k"] for r in facets.content_matches(rows, bag, "k", "the re", phrase=False).collect()] == [1]


def test_tag_frequency_cap(spark):
    tags = spark.createDataFrame([(w, "common") for w in range(81)] + [(w, "known") for w in range(80)], "work int, tag string")
    assert {r["tag"] for r in related.weighted(tags, "work", "tag").select("tag").distinct().collect()} == {"known"}


def test_postings_come_in_blocks(spark):
    pairs = spark.createDataFrame([("t", i) for i in (9, 1, 1, 12)], "term string, k long")
    got = {(r["block"], tuple(r["keys"])) for r in tfidf.postings(pairs, "term", "k", size=10).collect()}
    assert got == {(0, (1, 9)), (1, (12,))}


def test_header_slices_of_deep_levels(spark):
    heads = spark.createDataFrame([(1, p, d) for p, d in enumerate([1, 2, 9, 7, 2, 1])], "doc int, pos int, depth int")
    assert [r["end"] for r in reader.header_slice(heads, "doc", "pos", "depth").orderBy("pos").collect()] == [5, 4, 3, 4, 5, None]


def test_neighbourhood_is_bounded(spark):
    links = spark.createDataFrame([(0, i) for i in range(1, 50)] + [(1, 100)], "source long, target long")
    got = [(r["node"], r["distance"]) for r in graph.neighbourhood(links, 0, 2, 10).collect()]
    assert got == [(0, 0), *((i, 1) for i in range(1, 10))]
