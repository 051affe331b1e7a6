"""Hierarchies and graphs: path trie, ancestors, cycles, transclusion, set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.sources.lineage import cut


def segments(slug: Column) -> Column:
    """Path segments; a last "index" belongs to its folder."""
    return F.filter(F.split(F.regexp_replace(slug, "(^|/)index$", ""), "/"), lambda x: F.length(x) > 0)


def trie(pages: DataFrame, slug: str) -> DataFrame:
    """(path, depth, is_folder, has_data, n_pages) of every node with its implicit folders."""
    segs = segments(F.col(slug))
    rows = pages.select(F.col(slug).alias("slug"), segs.alias("segs"), F.col(slug).rlike("(^|/)index$").alias("is_index"))
    steps = F.transform(F.sequence(F.lit(0), F.size("segs")), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice("segs", F.lit(1), i), "/").alias("path"), (i == F.size("segs")).alias("own")))
    nodes = rows.select("is_index", F.explode(steps).alias("n")).select("is_index", "n.*")
    return nodes.groupBy("path").agg(F.max("depth").cast("long").alias("depth"), F.max(~F.col("own") | F.col("is_index")).alias("is_folder"), F.max("own").alias("has_data"), F.count("*").alias("n_pages"))


def ancestors(slug: Column) -> Column:
    """Paths from the root to the slug itself."""
    segs = segments(slug)
    return F.transform(F.sequence(F.lit(0), F.size(segs)), lambda i: F.array_join(F.slice(segs, F.lit(1), i), "/"))


def folder_paths(nodes: DataFrame) -> DataFrame:
    """Slugs of all folders: the path's index page."""
    return nodes.where("is_folder").select(F.when(F.col("path") == "", F.lit("index")).otherwise(F.concat("path", F.lit("/index"))).alias("folder"))


def pre_order(nodes: DataFrame) -> DataFrame:
    """Nodes in pre-order: parents first, siblings by segment."""
    return nodes.orderBy(F.split("path", "/"))


def pruned(nodes: DataFrame, drop: Column) -> DataFrame:
    """Without the nodes that match and all below them."""
    gone = nodes.where(drop).select(F.col("path").alias("g"))
    up = nodes.select("path", F.explode(ancestors(F.col("path"))).alias("a"))
    return nodes.join(up.join(gone, F.col("a") == F.col("g"), "left_semi").select("path").distinct(), "path", "left_anti")


def display_name(override: Column, title: Column, file_name: Column, slug: Column) -> Column:
    """Override, else a title other than "index", else the file's or the slug's last segment."""
    last = lambda c: F.regexp_extract(F.regexp_replace(c, "/index$", ""), "([^/]+)$", 1)
    return F.coalesce(override, F.when((title != "index") & (F.length(title) > 0), title), F.when(F.length(file_name) > 0, last(file_name)), last(slug))


def cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle) of nodes that reach themselves, by a shortest cycle; edges: src, dst.

    Each round follows the edges from the nodes that a start reached last, and keeps the
    least path to each node that it had not reached; so the rounds are as many as the
    longest shortest path, and paths through nodes seen before end.
    """
    edges = cut(edges.select("src", "dst").distinct())
    new = cut(edges.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.array("src", "dst").alias("path")))
    seen, found = new.select("start", "node"), new.where("start = node")
    while not new.isEmpty():
        ahead = new.where("start <> node").join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        new = cut(ahead.groupBy("start", "node").agg(F.min("path").alias("path")).join(seen, ["start", "node"], "left_anti"))
        seen = cut(seen.union(new.select("start", "node")))
        found = found.union(new.where("start = node"))
    return found.select(F.col("start").alias("node"), F.array_join("path", ">").alias("cycle"))


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) reached from the roots, the roots included; a round for each step of the longest shortest path.

    A node is followed once for each root: what was reached before is taken out of each round.
    """
    edges = cut(edges.select("src", "dst").distinct())
    first = F.col(roots.columns[0])
    new = seen = cut(roots.select(first.alias("root"), first.alias("node")).distinct())
    while not new.isEmpty():
        ahead = new.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        new = cut(ahead.join(seen, ["root", "node"], "left_anti"))
        seen = cut(seen.union(new))
    return seen


def neighbourhood(links: DataFrame, root, depth: int, most: int) -> DataFrame:
    """(node, distance) within ``depth`` links of a page, in either direction: the nearest ``most``, then by name.

    Each round joins only the nodes found last, at most ``most`` of them.
    """
    both = links.select(F.col("source").alias("u"), F.col("target").alias("v")).union(links.select(F.col("target").alias("u"), F.col("source").alias("v"))).where("u <> v")
    kind = links.schema["source"].dataType
    seen = new = links.sparkSession.createDataFrame([(root, 0)], "node string, distance int").select(F.col("node").cast(kind).alias("node"), "distance")
    for k in range(1, depth + 1):
        ahead = both.join(F.broadcast(new), F.col("u") == F.col("node")).select(F.col("v").alias("node")).distinct()
        new = cut(ahead.join(F.broadcast(seen.select("node")), "node", "left_anti").orderBy("node").limit(most).withColumn("distance", F.lit(k)))
        seen = seen.union(new)
    return seen.orderBy("distance", "node").limit(most)


def redirects(pages: DataFrame, slug: str, aliases: str) -> DataFrame:
    """(alias, target) of pages' aliases, without those that are pages themselves; the least page has a shared alias."""
    rows = pages.select(F.explode(aliases).alias("alias"), F.col(slug).alias("target")).groupBy("alias").agg(F.min("target").alias("target"))
    return rows.join(pages.select(F.col(slug).alias("alias")), "alias", "left_anti")


def transclusion_targets(refs: DataFrame, ref: str, pages: DataFrame, slug: str) -> DataFrame:
    """Adds target: the exact slug, else the greatest that is the reference without its extension."""
    names = pages.select(F.col(slug).alias("__s"))
    bare = F.regexp_replace(ref, r"\.[^/.]+$", "")
    one = names.select(F.col("__s").alias("__exact"))
    out = refs.join(one, F.col(ref) == F.col("__exact"), "left")
    stem = names.groupBy(F.regexp_replace("__s", r"\.[^/.]+$", "").alias("__stem")).agg(F.max("__s").alias("__near"))
    out = out.withColumn("__bare", bare).join(stem, F.col("__bare") == F.col("__stem"), "left")
    return out.withColumn("target", F.coalesce("__exact", "__near")).drop("__exact", "__bare", "__stem", "__near")


def dependency_problems(entries: DataFrame) -> DataFrame:
    """(name, dependency, problem) of missing, disabled and later-ordered dependencies.

    entries: name, enabled, ord, dependencies.
    """
    dep = entries.where("enabled").select("name", "ord", F.explode("dependencies").alias("dependency"))
    known = entries.select(F.col("name").alias("dependency"), F.col("enabled").alias("d_enabled"), F.col("ord").alias("d_ord"))
    rows = dep.join(known, "dependency", "left")
    problem = F.when(F.col("d_enabled").isNull(), "missing").when(~F.col("d_enabled"), "disabled").when(F.col("ord") < F.col("d_ord"), "order")
    return rows.withColumn("problem", problem).where("problem is not null").select("name", "dependency", "problem")


def backlinks(links: DataFrame, size: int = 4096) -> DataFrame:
    """(target, block, n, sources) of links (source, target): integer sources in blocks of ``size`` consecutive values."""
    block = F.expr(f"source div {size}").alias("block")
    return links.select("source", "target").distinct().groupBy("target", block).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("source")).alias("sources"))


def only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a whose key b lacks."""
    return a.join(b.select(key).distinct(), key, "left_anti")


def extension_aliases(slugs: DataFrame, slug: str, extensions: list[str]) -> DataFrame:
    """Slugs without each extension that they end in, where there is no such slug yet."""
    found = None
    for e in extensions:  # a projection for each extension, no join
        part = slugs.where(F.col(slug).endswith(e)).select(F.expr(f"left({slug}, length({slug}) - {len(e)})").alias(slug))
        found = part if found is None else found.union(part)
    return found.distinct().join(slugs.select(slug), slug, "left_anti")


def unique_basenames(pages: DataFrame, slug: str) -> DataFrame:
    """(name, target) of last segments that one slug alone has."""
    name = F.regexp_extract(slug, "([^/]+)/?$", 1)
    return pages.select(name.alias("name"), F.col(slug).alias("s")).groupBy("name").agg(F.count("*").alias("n"), F.min("s").alias("target")).where("n = 1").drop("n")
