"""Works and their atoms: grouping, metadata with defaults, labels, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T


def work_key(work: Column, folder: Column) -> Column:
    """The named work, else the folder's name."""
    return F.coalesce(F.when(F.length(work) > 0, work), folder)


def with_translations(atoms: DataFrame, siblings: DataFrame, key: str) -> DataFrame:
    """Adds translations map<lang, body>. siblings: key, lang, body."""
    m = siblings.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "body")))).alias("translations"))
    return atoms.join(m, key, "left").withColumn("translations", F.coalesce("translations", F.create_map().cast("map<string,string>")))


def without_apparatus(atoms: DataFrame, title: str) -> DataFrame:
    return atoms.where(~F.coalesce(T.apparatus(F.col(title)), F.lit(False)))


def with_atoms(works: DataFrame, atoms: DataFrame, key: str) -> DataFrame:
    """The works that still have an atom."""
    return works.join(atoms.select(key).distinct(), key, "left_semi")


def shelf_order(philosopher: Column, title: Column) -> Column:
    """Order of works: philosopher and title as one string, by Unicode collation."""
    return F.collate(F.concat(F.coalesce(philosopher, F.lit("")), F.coalesce(title, F.lit(""))), "UNICODE")


def flat_title(title: Column) -> Column:
    return F.trim(F.coalesce(title, F.lit(""))).isin("") | (F.lower(F.trim(title)) == "(intero)")


def padded(n: Column, width: int = 3) -> Column:
    """Zero-padded, never cut."""
    s = n.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def labelled(atoms: DataFrame, work: str, title: str, number: str, work_title: str) -> DataFrame:
    """Adds position, atom_id, is_intro, chapter and label in reading order.

    Same titles (untrimmed) are numbered "title (k/n)"; the first atom takes the
    work's title; untitled atoms are "Parte n".
    """
    order = [F.coalesce(F.col(number), F.lit(0)), F.col(number)]
    by_work = Window.partitionBy(work).orderBy(*order)
    group = Window.partitionBy(work, F.coalesce(title, F.lit("")))
    df = atoms.withColumn("position", F.row_number().over(by_work).cast("long"))
    df = df.withColumn("__k", F.row_number().over(group.orderBy(*order))).withColumn("__n", F.count("*").over(group))
    shown = F.coalesce(F.col(number).cast("long"), F.col("position"))
    flat, trimmed = flat_title(F.col(title)), F.trim(title)
    label = F.when(F.col("position") == 1, F.col(work_title)).when(flat, F.concat(F.lit("Parte "), shown.cast("string"))).when(F.col("__n") > 1, F.concat(trimmed, F.lit(" ("), F.col("__k").cast("string"), F.lit("/"), F.col("__n").cast("string"), F.lit(")"))).otherwise(trimmed)
    return df.withColumn("atom_id", padded(shown)).withColumn("is_intro", F.col("position") == 1).withColumn("chapter", F.when(flat, F.lit("")).otherwise(trimmed)).withColumn("label", label).drop("__k", "__n")


def totals(atoms: DataFrame, work: str, body: str) -> DataFrame:
    return atoms.groupBy(work).agg(F.sum(T.count_words(F.col(body))).alias("words"), F.count("*").alias("atoms"))


# Language names of the source line.
LANGUAGES = {"en": "inglese", "de": "tedesco", "fr": "francese", "es": "spagnolo", "la": "latino", "it": "italiano", "grc": "greco"}


def source_line(translator: Column, edition: Column, year: Column, lang: Column) -> Column:
    """Citation: translator, or original language, with the edition; empty if there is nothing to cite."""
    full = lambda c: F.when(F.length(c.cast("string")) > 0, c.cast("string"))
    ed = F.concat_ws(", ", full(edition), F.when(year.cast("string") != "0", full(year)))
    name = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.lower(F.coalesce(lang, F.lit(""))))
    who = F.when(F.length(translator) > 0, F.concat(F.lit("Traduzione di "), translator)).when(name.isNotNull(), F.concat(F.lit("Testo originale "), name))
    bits = F.concat_ws(" · ", who, F.when(F.length(ed) > 0, ed))
    return F.when(F.length(bits) > 0, F.concat(F.lit('<p class="work-source">'), T.html_escape(F.concat(bits, F.lit(" · pubblico dominio"))), F.lit("</p>"))).otherwise(F.lit(""))


def records(works: DataFrame, meta: DataFrame, tags: DataFrame | None, key: str, root: str = "testi") -> DataFrame:
    """Work records: metadata before the first atom's values before defaults; author is philosopher.

    works: key, philosopher, lang, edizione, traduttore, pd_year (of the first atom), words, atoms.
    meta: key and the same columns with title and kind.
    """
    m = meta.select(key, *[F.col(c).alias(f"m_{c}") for c in meta.columns if c != key])
    df = works.join(m, key, "left")
    who = T.falsy(F.col("m_philosopher"), F.col("philosopher"))
    title = T.falsy(F.trim("m_title"), T.prettify(F.col(key)))
    pick = lambda c, default: T.nullish(F.col(f"m_{c}"), F.col(c), F.lit(default))
    href = T.url_slug(F.concat_ws("/", F.lit(root), F.lower(who), F.col(key)))
    df = df.select(key, href.alias("href"), title.alias("title"), who.alias("philosopher"), who.alias("author"), pick("lang", "").alias("lang"), T.falsy(F.col("m_kind"), F.lit("work")).alias("kind"), "words", "atoms", pick("edizione", "").alias("edizione"), pick("traduttore", "").alias("traduttore"), T.nullish(F.col("m_pd_year"), F.col("pd_year")).alias("pd_year"))
    return df if tags is None else df.join(tags, ["philosopher", key], "left")
