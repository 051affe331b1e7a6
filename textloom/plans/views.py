"""Queries on published views: enriched works, shelves, pages, folders, neighbourhoods, shards, parsed notes."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import facets, frontmatter, graph, pages, related, tables, vocab, works
from textloom.plans import records
from textloom.sources import lineage, readers, sinks
from textloom.sources.readers import table


def related_enriched(s, d):
    """Related orders with their titles and authors."""
    shelf = table(s, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("title"), F.col("o_custkey").alias("philosopher"))
    out = related.enriched(records.affinity_topn(s, d), shelf, "o_orderkey", ["title", "philosopher"])
    return out.select("atom", "other", "rank", "shared", "title", "philosopher")


def works_order(s, d):
    """Places of works on their language's shelf."""
    docs = table(s, d, "documents").select("doc_id", "lang", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("title"))
    order = Window.partitionBy("lang").orderBy(works.shelf_order(F.col("source"), F.col("title")))
    return docs.select("doc_id", F.row_number().over(order).cast("long").alias("place"))


def works_with_atoms(s, d):
    """Customers as works, of which those without an order go."""
    return works.with_atoms(table(s, d, "customer").select("c_custkey", "c_name"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def table_page_from_zero(s, d):
    """The third page, counted from 0, in the column's first direction."""
    df = table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    keys = tables.sort_keys(df, "c_acctbal", tables.first_direction(df, "c_acctbal"), "c_name")
    return tables.page_from_zero(df, keys, 2, 25).select("c_custkey", "rank")


def facet_ranks(s, d):
    """Places of facet values in their list."""
    n = facets.counts(table(s, d, "part").select("p_brand", "p_size"), ["p_brand", "p_size"])
    return n.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(F.col("n").desc(), F.collate("value", "UNICODE"))).cast("long"))


def _slugs(s, d):
    """Slugs language/source/id of documents; the language "es" stands for a hidden folder."""
    lang = F.when(F.col("lang") == "es", "tags").otherwise(F.col("lang"))
    return table(s, d, "documents").select("doc_id", F.concat_ws("/", lang, "source", F.col("doc_id").cast("string")).alias("slug"), "lang", "source")


def explorer(s, d):
    return _slugs(s, d).where(pages.in_explorer()).select("slug")


def known_folders(s, d):
    kinds = table(s, d, "nation").where("n_nationkey < 3").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source"), F.col("n_name").alias("type"))
    return pages.known_folders(_slugs(s, d), "source", kinds).select("doc_id", "type")


def published(s, d):
    """Documents that pass two rules, and those that one of them drops."""
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").withColumn("draft", F.col("toxic") == 1)
    kept, gone = pages.published(docs, [pages.not_draft(), F.coalesce(F.col("quality") != 0, F.lit(True))])
    return kept.select("doc_id", F.lit(True).alias("live")).unionByName(gone.select("doc_id", F.lit(False).alias("live")))


def emitted(s, d):
    return pages.emitted(table(s, d, "documents"), "lang")


def folder_index(s, d):
    """Generated pages of all folders."""
    return pages.folder_pages(graph.folder_paths(graph.trie(_slugs(s, d), "slug")), "folder").select("slug")


def redirects(s, d):
    """Parts' names and brands as aliases."""
    parts = table(s, d, "part").select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("slug"), F.array("p_brand", F.concat(F.lit("p/"), (F.col("p_partkey") + 1).cast("string"))).alias("aliases"))
    return graph.redirects(parts, "slug", "aliases")


def neighbourhood(s, d):
    """The 220 pages nearest to page 1 within two links; each page links to twice its number and to the next."""
    n = F.col("p_partkey")
    links = table(s, d, "part").select(n.alias("source"), F.explode(F.array(n * 2, n * 3 + 1)).alias("target"))
    return graph.neighbourhood(links, 1, 2, 220).select("node", F.col("distance").cast("long").alias("distance"))


def transclusions(s, d):
    """References by full name or without an extension."""
    slugs = table(s, d, "part").select(F.concat(F.lit("n/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".md").otherwise("")).alias("slug"))
    refs = table(s, d, "part").select("p_partkey", F.concat(F.lit("n/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 4 == 0, ".md").when(F.col("p_partkey") % 4 == 1, ".txt").otherwise("")).alias("ref"))
    return graph.transclusion_targets(refs, "ref", slugs, "slug").select("p_partkey", "target")


def shard_lookup(s, d):
    """Related blocks written in shards, and one shard read again through the manifest."""
    folder = f"{lineage.folder(s)}/shards-{uuid.uuid4().hex}"
    t = table(s, d, "conversations").select((F.col("conv_id") % 16).cast("string").alias("shard"), "conv_id", "turn", F.length("text").cast("long").alias("size"))
    manifest = sinks.sharded(t, folder, "shard")
    keys = [r[0] for r in manifest.where(F.col("shard").cast("string").isin("3", "99")).collect()]  # of two keys, those that exist
    found = [readers.shard(s, folder, "shard", k).select("conv_id", "turn", "size") for k in keys]
    return found[0] if found else t.limit(0).select("conv_id", "turn", "size")


def wikilink_rewrite(s, d):
    """Notes that link to a nation by key, by name with a label, and to nowhere."""
    c, n = table(s, d, "customer"), F.col("c_nationkey").cast("string")
    notes = c.select("c_custkey", F.concat(F.lit("See [[k"), n, F.lit("]], [[n"), F.col("c_custkey").cast("string"), F.lit("|no one]] and [[ k"), n, F.lit(" |"), "c_mktsegment", F.lit("]].")).alias("body"))
    k = table(s, d, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("target"), F.col("n_name").alias("title"))
    targets = k.select("target", F.concat(F.lit("works/"), "target").alias("href"), "title", F.lit(1).alias("priority")).union(k.select("target", F.concat(F.lit("other/"), "target"), F.lit("x"), F.lit(2)))
    return vocab.rewritten(notes, "c_custkey", "body", targets).select("c_custkey", "body")


def frontmatter_parse(s, d):
    """Notes of documents: a typed block with lists, or none for every fifth."""
    i = F.col("doc_id").cast("string")
    block = F.concat(F.lit("---\ntitle: \"No "), i, F.lit("\"\nyear: "), i, F.lit("\nlive: true\nnone: ~\ntags: [x, '"), "source", F.lit("', ]\nalias:\n  - \"p\"\n  - "), "lang", F.lit("\nempty:\nyear: -"), i, F.lit(".5\n--- no key\n---\nBody"))
    rows = frontmatter.parsed(table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, block).otherwise(F.concat(F.lit("no block "), i)).alias("raw")))
    flat = rows.select("doc_id", F.explode(F.map_entries("data")).alias("e"))
    return flat.select("doc_id", F.col("e.key").alias("key"), F.col("e.value.kind").alias("kind"), F.col("e.value.scalar").alias("scalar"), F.array_join("e.value.items", "|").alias("items"))


def package_sources(s, d):
    """Package sources in seven forms."""
    k, i = F.col("s_suppkey") % 7, F.col("s_suppkey").cast("string")
    forms = [("github:o/r", ""), ("github:o/r", "#dev"), ("git+https://h.org/a/b", ".git#x"), ("https://h.org/a/b", ""), ("./local/p", ""), ("o/r", ""), ("nonsense", "")]
    c = F.lit(None).cast("string")
    for n, (a, b) in enumerate(forms):
        c = F.when(k == n, F.concat(F.lit(a), i, F.lit(b))).otherwise(c)
    return table(s, d, "supplier").select("s_suppkey", c.alias("source")).select("s_suppkey", "source", T.package_source(F.col("source")).alias("p")).select("s_suppkey", "source", "p.*")


FRONT_SQL = """WITH n AS (SELECT * FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id, 'title' AS key, 'string' AS kind, 'No ' || doc_id AS scalar, NULL AS items FROM n UNION ALL SELECT doc_id, 'year', 'number', '-' || doc_id || '.5', NULL FROM n UNION ALL SELECT doc_id, 'live', 'boolean', 'true', NULL FROM n
UNION ALL SELECT doc_id, 'none', 'null', NULL, NULL FROM n UNION ALL SELECT doc_id, 'tags', 'list', NULL, 'x|' || source FROM n UNION ALL SELECT doc_id, 'alias', 'list', NULL, 'p|' || lang FROM n UNION ALL SELECT doc_id, 'empty', 'list', NULL, '' FROM n"""
PACKAGE_SQL = """WITH x AS (SELECT s_suppkey, s_suppkey % 7 AS k, s_suppkey::VARCHAR AS i FROM supplier)
SELECT s_suppkey, CASE k WHEN 0 THEN 'github:o/r' || i WHEN 1 THEN 'github:o/r' || i || '#dev' WHEN 2 THEN 'git+https://h.org/a/b' || i || '.git#x' WHEN 3 THEN 'https://h.org/a/b' || i WHEN 4 THEN './local/p' || i WHEN 5 THEN 'o/r' || i ELSE 'nonsense' || i END AS source,
CASE WHEN k IN (0, 1, 5) THEN 'github' WHEN k = 2 THEN 'git' WHEN k = 3 THEN 'https' WHEN k = 4 THEN 'local' END AS kind, CASE WHEN k IN (0, 1, 5) THEN 'r' || i WHEN k IN (2, 3) THEN 'b' || i WHEN k = 4 THEN 'p' || i END AS name,
CASE WHEN k IN (0, 1, 5) THEN 'https://github.com/o/r' || i || '.git' WHEN k = 2 THEN 'https://h.org/a/b' || i || '.git' WHEN k = 3 THEN 'https://h.org/a/b' || i WHEN k = 4 THEN './local/p' || i END AS repo,
CASE k WHEN 0 THEN 'main' WHEN 1 THEN 'dev' WHEN 2 THEN 'x' WHEN 3 THEN 'main' WHEN 5 THEN 'main' END AS ref FROM x"""
SLUGS = "slugs AS (SELECT doc_id, CASE lang WHEN 'es' THEN 'tags' ELSE lang END || '/' || source || '/' || doc_id AS slug, lang, source FROM documents)"
NEAR_SQL = """WITH l AS (SELECT p_partkey AS u, unnest([p_partkey * 2, p_partkey * 3 + 1]) AS v FROM part), e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
one AS (SELECT DISTINCT v AS node, 1::BIGINT AS distance FROM e WHERE u = 1 AND v <> 1), two AS (SELECT DISTINCT e.v AS node, 2::BIGINT AS distance FROM e JOIN one ON e.u = one.node WHERE e.v <> 1 AND e.v NOT IN (SELECT node FROM one))
SELECT 1::BIGINT AS node, 0::BIGINT AS distance UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two ORDER BY distance, node LIMIT 220"""

QUERIES = {
    "related_enriched": (related_enriched, f"WITH a AS ({records.AFFINITY_SQL}) SELECT atom, other, rank, shared, o_orderpriority AS title, o_custkey AS philosopher FROM a JOIN orders ON o_orderkey = other"),
    "works_order": (works_order, "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY source || lpad(doc_id::VARCHAR, 9, '0')) AS place FROM documents"),
    "works_with_atoms": (works_with_atoms, "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "table_page_from_zero": (table_page_from_zero, "SELECT c_custkey, rank FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_name) AS rank FROM customer) WHERE rank BETWEEN 51 AND 75"),
    "facet_ranks": (facet_ranks, "WITH f AS (SELECT 'p_brand' AS facet, p_brand AS value FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part), n AS (SELECT facet, value, count(*) AS n FROM f GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS place FROM n"),
    "explorer": (explorer, f"WITH {SLUGS} SELECT slug FROM slugs WHERE lang <> 'es'"),
    "known_folders": (known_folders, "SELECT doc_id, n_name AS type FROM documents JOIN nation ON source = 'src' || n_nationkey WHERE n_nationkey < 3"),
    "published": (published, "SELECT doc_id, NOT coalesce(toxic = 1, false) AND coalesce(quality <> 0, true) AS live FROM documents LEFT JOIN labels USING (doc_id)"),
    "emitted": (emitted, "SELECT lang, count(*) AS files FROM documents GROUP BY ROLLUP (lang)"),
    "folder_index": (folder_index, f"WITH {SLUGS}, x AS (SELECT string_split(slug, '/') AS g FROM slugs) SELECT 'index' AS slug UNION SELECT g[1] || '/index' FROM x UNION SELECT g[1] || '/' || g[2] || '/index' FROM x"),
    "redirects": (redirects, "WITH x AS (SELECT 'p/' || p_partkey AS slug, unnest([p_brand, 'p/' || (p_partkey + 1)]) AS alias FROM part) SELECT alias, min(slug) AS target FROM x WHERE alias NOT IN (SELECT 'p/' || p_partkey FROM part) GROUP BY alias"),
    "neighbourhood": (neighbourhood, NEAR_SQL),
    "transclusions": (transclusions, "SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN 'n/' || p_partkey WHEN 1 THEN 'n/' || p_partkey ELSE 'n/' || p_partkey || '.md' END AS target FROM part"),
    "shard_lookup": (shard_lookup, "SELECT conv_id, turn, length(text) AS size FROM conversations WHERE conv_id % 16 = 3"),
    "wikilink_rewrite": (wikilink_rewrite, "SELECT c_custkey, 'See [' || n_name || '](/works/k' || n_nationkey || '), no one and [' || c_mktsegment || '](/works/k' || n_nationkey || ').' AS body FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "frontmatter_parse": (frontmatter_parse, FRONT_SQL),
    "package_sources": (package_sources, PACKAGE_SQL),
}
