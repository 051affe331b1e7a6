"""Slug and link functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_slug(c: Column) -> Column:
    """Slug of a content file: no .md or .html, "_index" is "index", marks as in page slugs; case stays."""
    c = F.regexp_replace(F.regexp_replace(c, "^/+", ""), r"\.(md|html)$", "")
    for pattern, to in ((r"\s", "-"), ("&", "-and-"), ("%", "-percent"), (r"[?#]", "")):
        c = F.regexp_replace(c, pattern, to)
    return F.regexp_replace(F.regexp_replace(c, "/$", ""), r"(^|/)_index$", "$1index")


def simple_slug(c: Column) -> Column:
    """Without a last "index" or leading slash; the root is "/"."""
    s = F.regexp_replace(F.regexp_replace(c, "(^|/)index$", "$1"), "^/+", "")
    return F.when(F.length(s) == 0, F.lit("/")).otherwise(s)


def path_to_root(slug: Column) -> Column:
    ups = F.size(F.filter(F.split(slug, "/"), lambda x: x != "")) - 1
    return F.when(ups <= 0, F.lit(".")).otherwise(F.array_join(F.array_repeat(F.lit(".."), F.greatest(ups, F.lit(1))), "/"))


def join_segments(*parts: Column) -> Column:
    """Parts with one slash between; outer slashes and protocols stay."""
    whole = F.concat_ws("/", *[F.when((F.length(p) > 0) & (p != "/"), p) for p in parts])
    last = F.when(parts[-1].endswith("/"), "/").otherwise("")
    one = F.regexp_replace(whole, r"(?<!:)/{2,}(?<!://)", "/")
    return F.concat(F.regexp_replace(one, "/+$", ""), last)


def resolve_relative(current: Column, target: Column) -> Column:
    """Relative URL from one slug to another; always starts with "." and the root is a folder."""
    to = F.regexp_replace(simple_slug(target), "^/$", "")
    root = path_to_root(current)
    return F.when(root == ".", F.concat(F.lit("./"), to)).otherwise(F.concat(root, F.lit("/"), to))


def anchor_slug(c: Column) -> Column:
    c = F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}\s_-]", "")
    return F.regexp_replace(c, r"\s", "-")


def split_anchor(c: Column) -> Column:
    """struct(path, anchor): the anchor is slugged and keeps its "#"."""
    has = c.contains("#")
    anchor = F.concat(F.lit("#"), anchor_slug(F.regexp_extract(c, "#(.*)$", 1)))
    return F.struct(F.regexp_replace(c, "#.*$", "").alias("path"), F.when(has, anchor).otherwise("").alias("anchor"))


def internal_link(c: Column) -> Column:
    """A written link as a relative URL to a slug."""
    path, anchor = split_anchor(c)["path"], split_anchor(c)["anchor"]
    prefix = F.regexp_extract(path, r"^((?:\.{1,2}/)*)", 1)
    prefix = F.when(F.length(prefix) > 0, prefix).when(path.isin("", "."), F.lit(".")).otherwise(F.lit("./"))
    rest = F.regexp_replace(F.regexp_replace(path, r"^(\.{1,2}/)+", ""), r"^\.$", "")
    folder = rest.endswith("/") | rest.rlike(r"(^|/)index(\.md|\.html)?$")
    slug = F.regexp_replace(F.regexp_replace(file_slug(F.regexp_replace(rest, "/$", "")), "(^|/)index$", ""), "^/+", "")
    tail = F.when(folder & (F.length(slug) > 0), "/").otherwise("")
    return F.concat(prefix, slug, tail, anchor)


def link_target(strategy: str, current: Column, target: Column, unique: Column | None = None) -> Column:
    """URL of a link. ``unique``: the one slug that has the target's last segment, or null.

    relative: as written; absolute: from the root; shortest: the unique slug, else from the root.
    """
    path, anchor = split_anchor(target)["path"], split_anchor(target)["anchor"]
    if strategy == "relative":
        return internal_link(target)
    to = F.regexp_replace(F.regexp_replace(internal_link(path), r"^(\.{1,2}/?)+", ""), "^/+", "")
    if strategy == "shortest" and unique is not None:
        to = F.coalesce(F.regexp_replace(simple_slug(unique), "^/$", ""), to)
    root = path_to_root(current)
    return F.concat(F.when(root == ".", "./").otherwise(F.concat(root, F.lit("/"))), to, anchor)


def is_simple_slug(c: Column) -> Column:
    return ~c.rlike(r"^\.|^/.|[#?&]|(^|/)index$|\.(md|html)$")


def is_relative_url(c: Column) -> Column:
    return c.rlike(r"^\.{1,2}(/|$)") & ~c.rlike(r"(^|/)index$|\.(md|html)$")


def is_full_slug(c: Column) -> Column:
    return ~c.rlike(r"^\.|^/|/$|[#?&\s]") & (F.length(c) > 0)


def is_file_path(c: Column) -> Column:
    return ~c.rlike(r"^\.") & c.rlike(r"\.[A-Za-z0-9]+$")


def slug_tag(c: Column) -> Column:
    """Slug of each part of a tag path."""
    return F.array_join(F.transform(F.split(c, "/"), lambda x: F.regexp_replace(F.lower(F.trim(x)), r"\s+", "-")), "/")


def rebase(base: Column, link: Column) -> Column:
    """A relative URL seen from another page: folder of base, then link, with . and .. resolved."""
    folder = F.regexp_replace(base, "[^/]*$", "")
    parts = F.split(F.when(link.startswith("/"), link).otherwise(F.concat(folder, link)), "/")
    empty = F.array().cast("array<string>")
    step = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x.isin(".", ""), acc).otherwise(F.concat(acc, F.array(x)))
    out = F.array_join(F.aggregate(parts, empty, step), "/")
    return F.when(link.rlike("^([a-z][a-z0-9+.-]*:|#)"), link).otherwise(F.concat(F.lit("/"), out, F.when(link.endswith("/") & (F.length(out) > 0), "/").otherwise("")))
