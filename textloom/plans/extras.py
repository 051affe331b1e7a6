"""Queries on single functions, reports and package tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import paths as P
from textloom.functions import text as T
from textloom.operators import facets, plugins, tables, vocab, works
from textloom.sources import readers, sinks
from textloom.sources.readers import table


def names(s, d):
    """Package names, Pascal case and code points of part names."""
    p = table(s, d, "part")
    return p.select("p_partkey", T.pascal_case(F.lower("p_name")).alias("pascal"), T.package_name(F.concat(F.lit("git+https://h.org/x/"), F.col("p_partkey").cast("string"), F.lit(".git#v1"))).alias("package"), T.code_points(F.col("p_name")).alias("points"))


def sort_keys(s, d):
    """Article-free keys, chapters and leaf labels."""
    p = table(s, d, "part").withColumn("t", F.concat(F.lit("The "), "p_type", F.lit(" (2/3)")))
    return p.select("p_partkey", T.no_article(F.col("t")).alias("key"), T.chapter_of(F.col("t")).alias("chapter"), T.leaf_label(F.concat("p_type", F.lit(": "), "p_brand"), F.col("p_type")).alias("leaf"))


def highlights(s, d):
    return table(s, d, "part").select("p_partkey", T.highlighted(F.concat(F.lit("<"), "p_type", F.lit(">")), F.lit("e")).alias("shown"))


def callouts(s, d):
    docs = table(s, d, "documents")
    return docs.select("doc_id", T.abstract_callout(F.when(F.col("doc_id") % 4 != 0, F.col("text")).otherwise(" \n ")).alias("callout"))


def stripped_headings(s, d):
    docs = table(s, d, "documents").withColumn("body", F.concat(F.lit("\n# "), "source", F.lit(" \n"), F.coalesce("text", F.lit(""))))
    return docs.select("doc_id", T.strip_leading_h1(F.col("body"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("other")).alias("body"))


def dates(s, d):
    o = table(s, d, "orders")
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("local"))


def styles(s, d):
    """URLs of style sheets, exploded."""
    css = table(s, d, "supplier").select("s_suppkey", F.concat(F.lit("@font-face{src:url('/f/"), F.col("s_suppkey").cast("string"), F.lit(".woff2') format(x), url( \"b.ttf\" )}")).alias("css"))
    return css.select("s_suppkey", F.explode(T.css_urls(F.col("css"))).alias("url"))


def missing_references(s, d):
    """Documents without a label, listed by source."""
    lost = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_anti")
    return lost.groupBy("source", F.expr("doc_id div 4096").alias("block")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("doc_id")), ",").alias("ids"))


def last_wins(s, d):
    """One row per source: the last document's."""
    docs = table(s, d, "documents").select("source", "doc_id", "lang", "n_chars")
    return readers.latest_by_key(docs, "source", "doc_id")


def byte_totals(s, d):
    docs = table(s, d, "documents").select(F.col("text").alias("full"), F.substring("text", 1, 80).alias("short"))
    return sinks.sizes(docs, "full", "short")


def author_filter(s, d):
    return table(s, d, "documents").where(F.col("source") == F.lit("src3")).select("doc_id")


def sitemap(s, d):
    return sinks.sitemap(table(s, d, "orders").select(F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("slug"), F.col("o_orderdate").alias("date")), "https://x.org/")


def package_table(s, d):
    config = table(s, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("github:o/"), "n_name").alias("source"))
    lock = table(s, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.concat(F.lit("github:o/"), F.when(F.col("n_nationkey") % 4 == 0, F.col("n_name")).otherwise("old")).alias("source"), F.lit("abc").alias("resolved"))
    manifests = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("category"))
    return plugins.enriched(config, lock, manifests).select("name", "category", "resolved", "installed", "modified")


def package_groups(s, d):
    members = table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("group"), F.col("n_nationkey").alias("ord"), (F.col("n_nationkey") * 10).alias("priority"))
    config = table(s, d, "region").where("r_regionkey < 2").select(F.col("r_regionkey").cast("string").alias("group"), F.lit(5).alias("priority"))
    return plugins.groups(members, config).select("group", "priority", F.array_join("names", ",").alias("names"))


def packages_per_category(s, d):
    return package_table(s, d).groupBy("category").agg(F.count("*").alias("n"), F.count_if("installed").alias("installed"))


def translations(s, d):
    """All later turns of a conversation as translations of its first."""
    turns = table(s, d, "conversations")
    first = turns.where("turn = 0").select("conv_id", F.col("text").alias("body"))
    others = turns.where("turn > 0").select("conv_id", F.concat(F.lit("l"), F.col("turn").cast("string")).alias("lang"), F.col("text").alias("body"))
    out = works.with_translations(first, others, "conv_id")
    return out.select("conv_id", "body", F.explode_outer("translations").alias("lang", "translation"))


def rebased_links(s, d):
    part = table(s, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"))
    return part.select("page_id", P.rebase(F.col("path"), F.lit("../img/a.png")).alias("up"), P.rebase(F.col("path"), F.lit("/css/x.css")).alias("root"), P.rebase(F.col("path"), F.lit("https://z.org/")).alias("outside"))


def concept_works(s, d):
    """Concepts with lists of works: exploded in order, unknown works dropped."""
    concepts = table(s, d, "nation").select("n_name", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (F.col("n_nationkey") * 97 + i * 13).cast("long")).alias("works"))
    rows = concepts.select("n_name", F.posexplode("works").alias("pos", "c_custkey"))
    return rows.join(table(s, d, "customer").select("c_custkey", "c_name"), "c_custkey").select("n_name", F.col("pos").cast("long").alias("pos"), "c_name")


def excerpt_order(s, d):
    """Excerpts by author, then work, then reading order: ranks within an author."""
    from pyspark.sql import Window

    t = table(s, d, "conversations").select("role", "conv_id", "turn")
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("role").orderBy("conv_id", "turn")).cast("long"))


def natural_order(s, d):
    """Folder names with numbers by value."""
    from pyspark.sql import Window

    case = F.when(F.col("p_partkey") % 2 == 0, F.lit("Étude ")).otherwise(F.lit("etude "))
    rows = table(s, d, "part").select("p_brand", F.concat(case, F.col("p_partkey").cast("string")).alias("name"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("p_brand").orderBy(tables.natural_key(F.col("name")))).cast("long"))


def facet_text_search(s, d):
    part = table(s, d, "part")
    return facets.matching(part, ["p_size::1", "p_size::2", "p_size::3"], query="a e", columns=["p_name", "p_type"]).select("p_partkey")


def vocabulary_union(s, d):
    one = table(s, d, "nation").select(F.col("n_name").alias("id"), F.lit("nation").alias("type"))
    two = table(s, d, "region").select(F.col("r_name").alias("id"), F.lit("region").alias("type"), F.col("r_regionkey").alias("axis"))
    nodes = one.unionByName(two, allowMissingColumns=True)
    tags = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name")
    return vocab.live_counts(nodes, "id", tags, "n_name")


REBASE_SQL = r"""WITH x AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS p FROM pages), y AS (SELECT page_id, list_filter(string_split(regexp_replace(p, '[^/]*$', ''), '/'), lambda z: z <> '') AS f FROM x)
SELECT page_id, '/' || array_to_string(list_concat(list_slice(f, 1, greatest(len(f) - 1, 0)), ['img', 'a.png']), '/') AS up, '/css/x.css' AS root, 'https://z.org/' AS outside FROM y"""

QUERIES = {
    "names": (names, "SELECT p_partkey, array_to_string(list_transform(regexp_split_to_array(lower(p_name), '[-_\\s]+'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '') AS pascal, p_partkey::VARCHAR AS package, array_to_string(list_transform(range(1, length(p_name) + 1), lambda i: format('{:x}', ord(substr(p_name, i, 1)))), '-') AS points FROM part"),
    "sort_keys": (sort_keys, "SELECT p_partkey, lower(p_type) || ' (2/3)' AS key, 'The ' || p_type AS chapter, p_brand AS leaf FROM part"),
    "highlights": (highlights, "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'e') THEN '&lt;' || substr(p_type, 1, instr(lower(p_type), 'e') - 1) || '<mark>' || substr(p_type, instr(lower(p_type), 'e'), 1) || '</mark>' || substr(p_type, instr(lower(p_type), 'e') + 1) || '&gt;' ELSE '&lt;' || p_type || '&gt;' END AS shown FROM part"),
    "callouts": (callouts, r"SELECT doc_id, CASE WHEN doc_id % 4 <> 0 AND trim(regexp_replace(text, '\s*\n\s*', ' ', 'g')) <> '' THEN '> [!abstract]' || chr(10) || '> ' || trim(regexp_replace(text, '\s*\n\s*', ' ', 'g')) END AS callout FROM documents"),
    "stripped_headings": (stripped_headings, "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE chr(10) || '# ' || source || ' ' || chr(10) || coalesce(text, '') END AS body FROM documents"),
    "dates": (dates, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%d/%m/%Y') AS local FROM orders"),
    "styles": (styles, "SELECT s_suppkey, unnest(['/f/' || s_suppkey || '.woff2', 'b.ttf']) AS url FROM supplier"),
    "missing_references": (missing_references, "SELECT source, doc_id // 4096 AS block, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL"),
    "last_wins": (last_wins, "SELECT source, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source"),
    "byte_totals": (byte_totals, "SELECT sum(strlen(text))::BIGINT AS full_bytes, sum(strlen(substr(text, 1, 80)))::BIGINT AS short_bytes FROM documents"),
    "author_filter": (author_filter, "SELECT doc_id FROM documents WHERE source = 'src3'"),
    "sitemap": (sitemap, "SELECT 'https://x.org/o/' || o_orderkey AS loc, strftime(o_orderdate, '%Y-%m-%d') AS lastmod FROM orders"),
    "package_table": (package_table, "SELECT n_name AS name, r_name AS category, CASE WHEN n_nationkey % 2 = 0 THEN 'abc' END AS resolved, n_nationkey % 2 = 0 AS installed, n_nationkey % 4 = 2 AS modified FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "package_groups": (package_groups, "SELECT n_regionkey::VARCHAR AS \"group\", CASE WHEN n_regionkey < 2 THEN 5 ELSE arg_min(n_nationkey * 10, n_nationkey) END AS priority, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey"),
    "packages_per_category": (packages_per_category, "SELECT r_name AS category, count(*) AS n, count(*) FILTER (n_nationkey % 2 = 0) AS installed FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "translations": (translations, "SELECT a.conv_id, a.text AS body, 'l' || b.turn AS lang, b.text AS translation FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn > 0 WHERE a.turn = 0"),
    "rebased_links": (rebased_links, REBASE_SQL),
    "concept_works": (concept_works, "WITH c AS (SELECT n_name, unnest(range(0, 4)) AS pos, n_nationkey FROM nation) SELECT n_name, pos, c_name FROM c JOIN customer ON c_custkey = n_nationkey * 97 + (pos + 1) * 13"),
    "excerpt_order": (excerpt_order, "SELECT role, conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS rank FROM conversations"),
    "natural_order": (natural_order, "SELECT p_brand, CASE p_partkey % 2 WHEN 0 THEN 'Étude ' ELSE 'etude ' END || p_partkey AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank FROM part"),
    "facet_text_search": (facet_text_search, "SELECT p_partkey FROM part WHERE p_size IN (1, 2, 3) AND (contains(lower(p_name), 'a') OR contains(lower(p_type), 'a')) AND (contains(lower(p_name), 'e') OR contains(lower(p_type), 'e'))"),
    "vocabulary_union": (vocabulary_union, "SELECT n_name AS id, 'nation' AS type, NULL::INTEGER AS axis, count(c_custkey) AS work_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name UNION ALL SELECT r_name, 'region', r_regionkey, 0 FROM region"),
}
