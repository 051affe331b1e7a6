"""Extension points: registries of transforms, filters, emitters and page types on frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_ORDER = 50


@dataclass
class Plugin:
    """What a plugin may give: any of the four hooks, in ``order`` (default 50)."""

    name: str
    order: int = DEFAULT_ORDER
    enabled: bool = True
    transform: Callable[[DataFrame], DataFrame] | None = None
    keep: Callable[[], Column] | None = None
    emit: Callable[[DataFrame], DataFrame] | None = None
    match: Callable[[], Column] | None = None
    priority: int = 0
    dependencies: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)

    def categories(self) -> list[str]:
        hooks = (("transformer", self.transform), ("filter", self.keep), ("emitter", self.emit), ("pageType", self.match))
        return [c for c, hook in hooks if hook is not None]


class Registry:
    """Plugins by name; a later one of a name replaces the earlier."""

    def __init__(self) -> None:
        self.plugins: dict[str, Plugin] = {}

    def add(self, plugin: Plugin) -> None:
        self.plugins[plugin.name] = plugin

    def active(self, category: str) -> list[Plugin]:
        found = [p for p in self.plugins.values() if p.enabled and category in p.categories()]
        return sorted(found, key=lambda p: p.order)

    def counts(self) -> dict[str, int]:
        return {c: len(self.active(c)) for c in ("transformer", "filter", "emitter", "pageType")}

    def run(self, df: DataFrame) -> dict[str, DataFrame]:
        """Transforms in order, then all filters, then every emitter's frame."""
        for p in self.active("transformer"):
            df = df.transform(p.transform)
        for p in self.active("filter"):
            df = df.where(F.coalesce(p.keep(), F.lit(False)))
        return {p.name: p.emit(df) for p in self.active("emitter")}


def merged(defaults: dict, options: dict) -> dict:
    """Options over defaults."""
    return {**defaults, **options}


def set_option(options: dict, assignment: str) -> dict:
    """key=value with a JSON value, else the text itself; dots go into nested options."""
    import json

    key, _, text = assignment.partition("=")
    try:
        value = json.loads(text)
    except ValueError:
        value = text
    out = dict(options)
    at = out
    *path, last = key.split(".")
    for p in path:
        at[p] = dict(at.get(p) or {})
        at = at[p]
    at[last] = value
    return out


def enriched(config: DataFrame, lock: DataFrame, manifests: DataFrame) -> DataFrame:
    """Configured plugins with their lock and manifest rows; modified if the source differs from the lock's."""
    lk = lock.select("name", F.col("source").alias("locked_source"), "resolved")
    out = config.join(lk, "name", "left").join(manifests, "name", "left")
    return out.withColumn("installed", F.col("locked_source").isNotNull()).withColumn("modified", F.col("locked_source").isNotNull() & (F.col("locked_source") != F.col("source")))


def groups(members: DataFrame, config: DataFrame) -> DataFrame:
    """Layout groups: the configured priority or the first member's, and the members in order."""
    g = members.groupBy("group").agg(F.min_by("priority", F.struct("ord", "name")).alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("names"))
    return g.join(config.select("group", F.col("priority").alias("configured")), "group", "left").select("group", F.coalesce("configured", "first").alias("priority"), "names")
