"""Related works: affinity by shared rare tags, contrast by opposed tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.sources import lineage
from textloom.sources.readers import parts

TOP_N, DF_CAP = 6, 80

#: Works of a tag or set of tags up to which all go with its atoms.
GROUP = 80


def weighted(tags: DataFrame, work: str, tag: str, cap: int = DF_CAP) -> DataFrame:
    """(tag, work, weight) of tags on at most ``cap`` works; weight 1 / log2(df + 1).

    The cap comes before any self-join, so a tag gives at most cap rows per atom.
    """
    pairs = tags.select(tag, work).distinct()
    df = pairs.groupBy(tag).agg(F.count("*").alias("df")).where(F.col("df") <= cap)
    return pairs.join(df, tag).select(tag, work, (1 / F.log2(F.col("df") + 1)).alias("weight"))


def _own(atoms: DataFrame, atom: str, work: str, tag: str) -> tuple[DataFrame, list[str], str]:
    """Atoms as (tag, atom, own), without ``own`` where atoms are works; the columns of an atom, and that of its work."""
    keys = [F.col(atom).alias("atom")] + ([F.col(work).alias("own")] if atom != work else [])
    out = atoms.where(F.col(work).isNotNull() & F.col(tag).isNotNull()).select(F.col(tag).alias("tag"), *keys)
    return out, out.columns[1:], out.columns[-1]


def _dealt(tags: DataFrame, work: str, tag: str, k: int) -> DataFrame:
    """Distinct (tag, atom), dealt by tag; the atom is a work or null.

    The aggregate keeps what is asked of the atom from being asked before the rows are dealt,
    else each way of reading the pairs would deal them once more.
    """
    rows = tags.where(F.col(tag).isNotNull()).select(F.col(tag).alias("tag"), F.col(work).alias("key")).repartition(k, "tag")
    return rows.groupBy("tag", "key").agg(F.max("key").alias("atom")).select("tag", "atom")


def _first(rows: DataFrame, group: list[str], n: int) -> DataFrame:
    """group, first: the least n values of ``other`` in each group."""
    least = Window.partitionBy(*group).orderBy(F.col("other").asc_nulls_last())
    rows = rows.withColumn("k", F.row_number().over(least)).where(F.col("k") <= n)
    return rows.groupBy(*group).agg(F.sort_array(F.collect_list("other")).alias("first"))


def _needed(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """tag, keys: the tags of an atom whose works can be among its n best without another tag in common.

    A tag on more than n + 1 works has n others with a known key, so none is needed that weighs
    less. rows: (tag, keys, df), dealt by atom.
    """
    weight = lambda x: F.round(1 / F.log2(x["df"] + 1), 9)
    sets = rows.groupBy(*keys).agg(F.collect_list(F.struct("df", "tag")).alias("g"))
    sets = sets.withColumn("least", F.array_max(F.transform(F.filter("g", lambda x: x["df"] > n + 1), weight)))
    return sets.select(*keys, F.explode(F.filter("g", lambda x: F.col("least").isNull() | (weight(x) >= F.col("least")))).alias("x")).select("x.tag", *keys)


def _couples(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t, u, rest: couples of a set's tags, those that aren't hot first, and the tags after the second."""
    sets = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("hot", "tag"))).alias("g"))
    ones = sets.select(*keys, "g", F.posexplode("g").alias("i", "x"))
    return ones.select(*keys, F.col("x.hot").alias("hot"), F.col("x.tag").alias("t"), F.posexplode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("j", "y"), F.slice("g", F.col("i") + 3, F.size("g")).alias("rest"))


def _hot(mine: DataFrame, theirs: DataFrame, keys: list[str], own: str, n: int) -> DataFrame | None:
    """(atom, other) that share two hot tags or more, as far as they can be among an atom's n best.

    Sets of hot tags grow by one tag a round. All works of a set go with its atoms where they
    are few; else only the first n + 1, as others share more tags or come after n works that
    share as much, and the set grows by each tag after its last.
    """
    theirs = lineage.cut(theirs.where("hot"))
    if theirs.isEmpty():
        return None
    mine = mine.where("hot")

    def start(rows: DataFrame, keys: list[str]) -> DataFrame:
        rows = _couples(rows, keys)
        rest = F.transform(F.slice("rest", F.col("j") + 1, F.size("rest")), lambda x: x["tag"])
        return rows.select(*keys, F.array("t", "y.tag").alias("set"), rest.alias("rest"))

    def grown(rows: DataFrame, large: DataFrame, keys: list[str]) -> DataFrame:
        rows = rows.join(large, "set", "left_semi").select(*keys, "set", "rest", F.posexplode("rest").alias("i", "v"))
        return rows.select(*keys, F.concat("set", F.array("v")).alias("set"), F.slice("rest", F.col("i") + 2, F.size("rest")).alias("rest"))

    a, w, found = start(mine, keys), start(theirs, ["atom"]), None
    while True:
        a, w = lineage.cut(a), lineage.cut(w)
        count = w.groupBy("set").agg(F.count("*").alias("c"))
        large = lineage.cut(count.where(F.col("c") > max(GROUP, n + 1)).select("set"))
        works = w.select("set", F.col("atom").alias("other"))
        few = works.join(large, "set", "left_anti")
        least = _first(works.join(large, "set", "left_semi"), ["set"], n + 1).select("set", F.explode("first").alias("other"))
        now = a.join(few.unionByName(least), "set").where(F.col("other") != F.col(own)).select("atom", "other")
        found = now if found is None else found.unionByName(now)
        if large.isEmpty():
            return found.distinct()
        a, w = grown(a, large, keys), grown(w, large, ["atom"])


def _sharing(atoms: DataFrame, works: DataFrame, df: DataFrame, keys: list[str], own: str, n: int, k: int, hot: bool) -> DataFrame:
    """(atom, other, s, shared) of works that share two tags or more with an atom.

    atoms: (tag, keys, df), works: (tag, atom, df), each dealt by atom.

    Couples of tags are joined, not works of a tag: a set of m tags gives m(m-1)/2 rows
    whatever the number of works. A couple with a tag on at most GROUP works has as many at
    most; couples of hot tags go another way.
    """
    mine, theirs = (rows.withColumn("hot", F.col("df") > GROUP).drop("df") for rows in (atoms, works))
    a = _couples(mine, keys).where("not hot").select(*keys, "t", F.col("y.tag").alias("u"))
    w = _couples(theirs, ["atom"]).where("not hot").select("atom", "t", F.col("y.tag").alias("u"))
    both = a.repartition(k, "t", "u").join(w.repartition(k, "t", "u").withColumnRenamed("atom", "other"), ["t", "u"]).where(F.col("other") != F.col(own))
    shared = both.select("atom", "other", F.explode(F.array("t", "u")).alias("tag")).distinct()
    if hot and (more := _hot(mine, theirs, keys, own, n)) is not None:
        more = more.join(atoms.select("atom", "tag"), "atom").join(works.select(F.col("atom").alias("other"), "tag"), ["other", "tag"])
        shared = shared.unionByName(more.select("atom", "other", "tag")).distinct()
    return shared.join(df, "tag").groupBy("atom", "other").agg(F.sum("weight").alias("s"), F.count("*").alias("shared"))


def affinity(atoms: DataFrame, tags: DataFrame, atom: str, work: str, tag: str, n: int = TOP_N, cap: int | None = DF_CAP) -> DataFrame:
    """The n other works that share most tag weight with an atom; tags on more than ``cap`` works don't count (None: all do).

    atoms: (atom, work, tag), distinct, of one work each; works that are atoms themselves come
    with atom = work, and with tags as atoms, which may repeat rows. Ties: number of shared tags, then the work.

    Of the works that share one tag only, no more than the tag's first n + 1 can be among an
    atom's n best: any other comes after n works with that tag. So each tag lists these for the
    atoms that need them, and those that share more are found by couples of tags.
    """
    k = parts(tags)
    pairs = _dealt(tags, work, tag, k)
    known = pairs.where(F.col("atom").isNotNull())
    mine, keys, own = (known, ["atom"], "atom") if atoms is tags and atom == work else _own(atoms, atom, work, tag)
    df = pairs.groupBy("tag").agg(F.count("*").alias("df"))
    df = (df if cap is None else df.where(F.col("df") <= cap)).withColumn("weight", 1 / F.log2(F.col("df") + 1))
    first = _first(pairs.withColumnRenamed("atom", "other"), ["tag"], n + 1)
    mine, works = (rows.join(df.select("tag", "df"), "tag").repartition(k, "atom") for rows in (mine, known))
    lists = _needed(mine, keys, n).repartition(k, "tag").join(df.join(first, "tag"), "tag").repartition(k, "atom").groupBy(*keys).agg(F.collect_list(F.struct("weight", "first")).alias("lists"))
    hot = (cap is None or cap > GROUP) and not tags.groupBy(tag).count().where((F.col("count") > GROUP) & F.col(tag).isNotNull()).isEmpty()
    sharing = _sharing(mine, works, df, keys, own, n, k, hot)
    place = lambda s, shared: [(-F.round(s, 9)).alias("a"), (-shared).alias("b")]
    best = Window.partitionBy("atom").orderBy(F.round("s", 9).desc(), F.col("shared").desc(), "other")
    sharing = sharing.repartition(k, "atom").withColumn("k", F.row_number().over(best)).where(F.col("k") <= n)
    sharing = sharing.groupBy("atom").agg(F.collect_list(F.struct(*place(F.col("s"), F.col("shared")), "other", "s", "shared")).alias("more"))
    one = F.lit(1).cast("long")
    ones = F.flatten(F.transform("lists", lambda x: F.transform(x["first"], lambda o: F.struct(*place(x["weight"], one), o.alias("other"), x["weight"].alias("s"), one.alias("shared")))))
    rows = lists.join(sharing, "atom", "left").select(*keys, "more", ones.alias("ones"))
    seen = lambda o: F.coalesce(F.exists("more", lambda x: x["other"] == o), F.lit(False))
    rows = rows.select("atom", F.coalesce("more", F.slice("ones", 1, 0)).alias("more"), F.filter("ones", lambda x: (x["other"] != F.col(own)) & ~seen(x["other"])).alias("ones"))
    return _ranked(rows, F.slice(F.sort_array(F.concat("more", "ones")), 1, n), atom, ["other", "s", "shared"])


def _ranked(rows: DataFrame, best: Column, atom: str, fields: list[str]) -> DataFrame:
    """A row per atom and entry of ``best``, with its rank."""
    rows = rows.select(F.col("atom").alias(atom), F.posexplode(best).alias("rank", "x"))
    return rows.select(atom, *[F.col("x")[f].alias(f) for f in fields], (F.col("rank") + 1).cast("long").alias("rank"))


def contrast(atoms: DataFrame, tags: DataFrame, opposed: DataFrame, atom: str, work: str, tag: str, n: int = TOP_N, cap: int | None = DF_CAP) -> DataFrame:
    """The n works tagged with an opposite of an atom's tag and not with that tag itself.

    atoms as in affinity(). opposed: (tag, against), directed. A work keeps its heaviest pair;
    ties: tag, then opposite. Each pair lists its first n + 1 works, the same for all atoms:
    any other comes after n works of that pair.
    """
    k = parts(tags)
    mine, keys, own = _own(atoms, atom, work, tag)
    other = weighted(tags, work, tag, cap).select(F.col(tag).alias("against"), F.col(work).alias("other"), "weight")
    pairs = opposed.select(F.col(tag).alias("tag"), "against").distinct().join(other, "against")
    both = tags.select(F.col(work).alias("other"), F.col(tag).alias("tag")).distinct()
    pairs = pairs.where(F.col("other").isNotNull()).join(both, ["other", "tag"], "left_anti")
    first = _first(pairs, ["tag", "against", "weight"], n + 1)
    lists = mine.join(first, "tag").repartition(k, "atom").groupBy(*keys).agg(F.collect_list(F.struct("tag", "against", "weight", "first")).alias("lists"))
    entry = lambda x, o: F.struct((-F.round(x["weight"], 9)).alias("a"), o.alias("other"), x["tag"].alias("tag"), x["against"].alias("against"), x["weight"].alias("weight"))
    found = F.flatten(F.transform("lists", lambda x: F.transform(x["first"], lambda o: entry(x, o))))
    rows = lists.select(*keys, found.alias("found")).select("atom", F.sort_array(F.filter("found", lambda x: x["other"] != F.col(own))).alias("found"))
    new = lambda best, x: (F.size(best) < n) & ~F.exists(best, lambda y: y["other"] == x["other"])
    best = F.aggregate("found", F.slice("found", 1, 0), lambda best, x: F.when(new(best, x), F.concat(best, F.array(x))).otherwise(best))
    return _ranked(rows, best, atom, ["other", "tag", "against", "weight"]).withColumnRenamed("tag", tag)


def enriched(found: DataFrame, works: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Related works with their titles and authors; works without a record go."""
    return found.join(works.select(F.col(key).alias("other"), *columns), "other")


def blocks(found: DataFrame, atom: str, fields: list[str]) -> DataFrame:
    """One row per atom with its related works in order."""
    return found.groupBy(atom).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("related"))
