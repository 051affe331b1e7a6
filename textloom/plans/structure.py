"""Queries on structure: paths, graphs, pages, packages, change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import paths as P
from textloom.functions import text as T
from textloom.operators import graph, pages, tables
from textloom.sources.readers import table
from textloom.streaming import incremental


def _slugs(s: SparkSession, d: str) -> DataFrame:
    """Host and path of each page, without query."""
    return table(s, d, "pages").select("page_id", F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]+)", 1), "/$", "").alias("slug"))


SLUGS = r"slugs AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]+)', 1), '/$', '') AS slug FROM pages)"
STEPS = f"""{SLUGS}, segs AS (SELECT slug, string_split(slug, '/') AS g FROM slugs),
steps AS (SELECT slug, len(g) AS n, unnest(range(0, len(g) + 1)) AS depth, g FROM segs),
nodes AS (SELECT array_to_string(list_slice(g, 1, depth), '/') AS path, depth, depth = n AS own FROM steps)"""


def path_trie(s, d):
    return graph.trie(_slugs(s, d), "slug")


def folder_paths(s, d):
    return graph.folder_paths(path_trie(s, d))


def path_ancestors(s, d):
    rows = _slugs(s, d).select("page_id", F.posexplode(graph.ancestors(F.col("slug"))).alias("depth", "ancestor"))
    return rows.select("page_id", F.col("depth").cast("long").alias("depth"), "ancestor")


def trie_pruned(s, d):
    return graph.pruned(path_trie(s, d), F.col("path").rlike("(^|/)en$")).select("path")


def link_resolve_shortest(s, d):
    slugs = _slugs(s, d)
    names = graph.unique_basenames(slugs.select("slug").distinct(), "slug")
    refs = slugs.select("page_id", "slug", F.regexp_extract("slug", "([^/]+)$", 1).alias("name"))
    out = refs.join(names, "name", "left")
    return out.select("page_id", P.link_target("shortest", F.col("slug"), F.col("name"), F.col("target")).alias("link"))


SHORTEST_SQL = rf"""WITH {SLUGS}, u AS (SELECT regexp_extract(slug, '([^/]+)$', 1) AS name, min(slug) AS target FROM (SELECT DISTINCT slug FROM slugs) GROUP BY 1 HAVING count(*) = 1),
x AS (SELECT page_id, slug, regexp_extract(slug, '([^/]+)$', 1) AS name FROM slugs), y AS (SELECT page_id, len(string_split(slug, '/')) - 1 AS ups, coalesce(target, regexp_replace(name, '\.(html|md)$', '')) AS t FROM x LEFT JOIN u USING (name))
SELECT page_id, CASE WHEN ups = 0 THEN './' ELSE repeat('../', ups) END || t AS link FROM y"""

def dep_validate(s, d):
    """Nations as packages: each depends on the region's name, which is no package, and on the nation after it."""
    n = table(s, d, "nation")
    names = n.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_name").alias("after"))
    rows = n.join(names, "n_nationkey", "left").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    deps = F.array_compact(F.array("after", "r_name"))
    return graph.dependency_problems(rows.select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 4 != 0).alias("enabled"), (F.col("n_nationkey") * 7 % 25).alias("ord"), deps.alias("dependencies")))


def dep_cycles(s, d):
    n = F.col("n_nationkey").cast("long")
    return graph.cycles(table(s, d, "nation").select(n.alias("src"), ((n * 3 + 1) % 25).alias("dst")))


def dep_closure(s, d):
    n = table(s, d, "nation")
    edges = n.select(F.col("n_nationkey").cast("long").alias("src"), ((F.col("n_nationkey") * 2 + 1) % 25).cast("long").alias("dst"))
    return graph.closure(edges, n.where("n_nationkey < 5").select(F.col("n_nationkey").cast("long").alias("root")))


CLOSURE_SQL = """WITH RECURSIVE w(root, node) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT FROM nation WHERE n_nationkey < 5 UNION SELECT root, (node * 2 + 1) % 25 FROM w) SELECT root, node FROM w"""


def set_prune(s, d):
    return graph.only_in(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels"), "doc_id")


def set_missing(s, d):
    return graph.only_in(table(s, d, "customer").select("c_custkey"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def extension_aliases(s, d):
    return graph.extension_aliases(_slugs(s, d).select("slug"), "slug", [".html", ".md"])


def backlinks(s, d):
    hrefs = table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target"))
    out = graph.backlinks(hrefs.withColumnRenamed("page_id", "source"))
    return out.select("target", "block", "n", F.array_join("sources", ",").alias("sources"))


def change_log_apply(s, d):
    ev = table(s, d, "events").select(F.col("user_id").alias("path"), "event_id", "event_type", "value")
    kind = F.when(F.col("event_type") == F.lit("click"), "delete").otherwise("change")
    state = table(s, d, "customer").select(F.col("c_custkey").alias("path"), F.col("c_acctbal").alias("value"))
    return incremental.applied(state, ev.withColumn("kind", kind), "path", "event_id", "kind", ["value"])


APPLY_SQL = """WITH last AS (SELECT user_id AS path, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS t FROM events GROUP BY 1)
SELECT c_custkey AS path, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT path FROM last) UNION ALL SELECT path, value FROM last WHERE t <> 'click'"""


def incremental_recompute(s, d):
    ev = table(s, d, "events").select("user_id", "event_id", "value")
    cut = ev.agg((F.max("event_id") * 0.8).cast("long").alias("cut"))
    rows = ev.join(F.broadcast(cut))  # one row
    total = lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    old = total(rows.where("event_id <= cut"))
    return incremental.recomputed(old, rows, rows.where("event_id > cut"), "user_id", total)


def partial_emit(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("path"), F.col("source").alias("title"))
    virtual = table(s, d, "nation").select(F.lit(-1).cast("long").alias("path"), F.col("n_name").alias("title"))
    ch = table(s, d, "labels").select(F.col("doc_id").alias("path"), F.when(F.col("quality") == 0, "delete").otherwise("change").alias("kind"))
    return incremental.partial(docs, virtual, ch, "path", "kind")


def page_dispatch(s, d):
    slugs = _slugs(s, d)
    kinds = [("german", 10, pages.some(F.col("slug").contains("/de/"))), ("document", 5, pages.every(pages.ext(".html"), pages.negate(F.col("slug").contains("/fr/")))), ("french", 1, F.col("slug").contains("/fr/"))]
    return pages.dispatched(slugs, kinds).select("page_id", "page_type")


def virtual_pages(s, d):
    docs = table(s, d, "documents").select(F.array(F.concat_ws("/", "lang", "source")).alias("tags"))
    return pages.tag_pages(docs, "tags").unionByName(pages.not_found_page(docs))


def page_list(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")).alias("date"), F.col("o_orderpriority").alias("title"))
    return tables.listing(o.withColumn("title", F.concat("title", F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))), "date", "title", limit=50).select("o_orderkey", "title")


def version_filter(s, d):
    """Versions made of three numbers of a part, held against another's."""
    text = lambda *c: F.concat_ws(".", *[F.expr(f"cast({x} as string)") for x in c])
    rows = table(s, d, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, "v").otherwise(""), text("p_size % 4", "p_partkey % 12", "p_size % 11")).alias("have"), F.when(F.col("p_partkey") % 9 == 0, "").otherwise(text("p_partkey % 4", "p_size % 12", "p_partkey % 11")).alias("need"))
    return rows.select("p_partkey", "have", "need", T.version_at_least(F.col("have"), F.col("need")).alias("ok"))


VERSION_SQL = """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'v' ELSE '' END || concat_ws('.', p_size % 4, p_partkey % 12, p_size % 11) AS have, CASE p_partkey % 9 WHEN 0 THEN '' ELSE concat_ws('.', p_partkey % 4, p_size % 12, p_partkey % 11) END AS need,
p_partkey % 9 = 0 OR (p_size % 4) * 10000 + (p_partkey % 12) * 100 + p_size % 11 >= (p_partkey % 4) * 10000 + (p_size % 12) * 100 + p_partkey % 11 AS ok FROM part"""


def relative_links(s, d):
    slugs = _slugs(s, d)
    return slugs.select("page_id", P.path_to_root(F.col("slug")).alias("root"), P.resolve_relative(F.col("slug"), F.lit("a/index")).alias("link"), P.slug_tag(F.lower("slug")).alias("tag"))


QUERIES = {
    "path_trie": (path_trie, f"WITH {STEPS} SELECT path, max(depth) AS depth, bool_or(NOT own) AS is_folder, bool_or(own) AS has_data, count(*) AS n_pages FROM nodes GROUP BY path"),
    "folder_paths": (folder_paths, f"WITH {STEPS} SELECT CASE WHEN path = '' THEN 'index' ELSE path || '/index' END AS folder FROM nodes GROUP BY path HAVING bool_or(NOT own)"),
    "path_ancestors": (path_ancestors, f"WITH {SLUGS}, x AS (SELECT page_id, string_split(slug, '/') AS g FROM slugs), y AS (SELECT page_id, g, unnest(range(0, len(g) + 1)) AS depth FROM x) SELECT page_id, depth, array_to_string(list_slice(g, 1, depth), '/') AS ancestor FROM y"),
    "trie_pruned": (trie_pruned, f"WITH {STEPS} SELECT DISTINCT path FROM nodes WHERE NOT regexp_matches(path, '(^|/)en(/|$)')"),
    "link_resolve_shortest": (link_resolve_shortest, SHORTEST_SQL),
    "dep_validate": (dep_validate, "SELECT a.n_name AS name, b.n_name AS dependency, CASE WHEN b.n_nationkey % 4 = 0 THEN 'disabled' ELSE 'order' END AS problem FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 WHERE a.n_nationkey % 4 <> 0 AND (b.n_nationkey % 4 = 0 OR a.n_nationkey * 7 % 25 < b.n_nationkey * 7 % 25) UNION ALL SELECT n_name, r_name, 'missing' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0"),
    "dep_cycles": (dep_cycles, "WITH RECURSIVE w(start, node, cycle, n) AS (SELECT n_nationkey::BIGINT, (n_nationkey * 3 + 1) % 25, n_nationkey || '>' || (n_nationkey * 3 + 1) % 25, 1 FROM nation UNION ALL SELECT start, (node * 3 + 1) % 25, cycle || '>' || (node * 3 + 1) % 25, n + 1 FROM w WHERE node <> start AND n < 26) SELECT start AS node, cycle FROM w WHERE node = start"),
    "dep_closure": (dep_closure, CLOSURE_SQL),
    "set_prune": (set_prune, "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "set_missing": (set_missing, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "extension_aliases": (extension_aliases, f"WITH {SLUGS}, x AS (SELECT DISTINCT regexp_replace(slug, '\\.(html|md)$', '') AS slug FROM slugs WHERE regexp_matches(slug, '\\.(html|md)$')) SELECT slug FROM x WHERE slug NOT IN (SELECT slug FROM slugs)"),
    "backlinks": (backlinks, """WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) SELECT target, page_id // 4096 AS block, count(*) AS n, string_agg(page_id::VARCHAR, ',' ORDER BY page_id) AS sources FROM l GROUP BY ALL"""),
    "change_log_apply": (change_log_apply, APPLY_SQL),
    "incremental_recompute": (incremental_recompute, "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id"),
    "partial_emit": (partial_emit, "SELECT doc_id AS path, source AS title FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality <> 0) UNION ALL SELECT -1::BIGINT, n_name FROM nation"),
    "page_dispatch": (page_dispatch, f"WITH {SLUGS} SELECT page_id, CASE WHEN contains(slug, '/de/') THEN 'german' WHEN (suffix(slug, '.html') OR NOT contains(slug, '.')) AND NOT contains(slug, '/fr/') THEN 'document' WHEN contains(slug, '/fr/') THEN 'french' END AS page_type FROM slugs WHERE page_type IS NOT NULL"),
    "virtual_pages": (virtual_pages, "SELECT 'tags/' || t AS slug, t AS title FROM (SELECT lang AS t FROM documents UNION SELECT lang || '/' || source FROM documents) UNION ALL SELECT '404', 'Not found'"),
    "page_list": (page_list, "SELECT o_orderkey, o_orderpriority || lpad(o_orderkey::VARCHAR, 12, '0') AS title FROM orders ORDER BY CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END DESC NULLS LAST, o_orderpriority, o_orderkey LIMIT 50"),
    "version_filter": (version_filter, VERSION_SQL),
    "relative_links": (relative_links, f"WITH {SLUGS}, x AS (SELECT page_id, slug, len(string_split(slug, '/')) - 1 AS ups FROM slugs) SELECT page_id, CASE WHEN ups = 0 THEN '.' ELSE rtrim(repeat('../', ups), '/') END AS root, CASE WHEN ups = 0 THEN './' ELSE repeat('../', ups) END || 'a/' AS link, lower(slug) AS tag FROM x"),
}
