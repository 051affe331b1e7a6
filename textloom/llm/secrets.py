"""Operator 7: secret scans, with character Markov models.

Base rules find assignments, access keys and long hex runs.  Beyond them, every
run of ``CANDIDATE`` outside the base spans is scored by the log-likelihood ratio
of two first-order character models: random strings against ordinary identifiers.
Runs above ``LEAST_LLR`` are spans of kind "random".

Both models are trained on a bounded sample, the ``SAMPLE`` documents with the
least hash of id and text, repeated rows once (a parameter): what the base rules match is labelled random
(a uniform prior over the alphabet stands for kinds of key that the sample lacks),
all other words are labelled ordinary, each distinct string once.  The model is a
table of at most 128 * 128 log-ratios.

All work is done by DataFrame functions; there is no shuffle but the training's
counts.  Match positions come from marks around each match: text between marks is
cut, and lengths of the parts add up to code-point positions.  Texts that hold the
mark characters have them replaced one for one first; no pattern uses them.

Defined cases: null text is empty (no spans); repeated rows repeat; overlapping
spans of different kinds all stay; other columns are ignored; without training
rows the ordinary model is uniform too and nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common as C

OPEN, CLOSE, FILL = "\u0001", "\u0002", "\u0003"
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"(AKIA[A-Z0-9]{14,})"
HEX = r"([0-9a-f]{16,})"
#: kind, pattern (group 1 is the match), quick test
BASE = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))
CANDIDATE = r"([A-Za-z0-9+/_=-]{16,})"
WORD = "[A-Za-z0-9+/_=-]+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SAMPLE = 4000
#: Log-likelihood ratio of a span: prior odds of one random string in e**LEAST_LLR words.
LEAST_LLR = 9.0
#: Pseudo-counts of each character after a context.
PRIOR = 2.0
#: Parts of a text, an even number, whose places are found together.
GROUP = 64
KINDS = ("assign", "access", "hex", "random")


def _parts(text: Column, pattern: str) -> Column:
    """Text cut around the matches: every second part is a match."""
    cut = F.split(F.regexp_replace(text, pattern, f"{OPEN}$1{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)
    return F.when(text.rlike(pattern), cut).otherwise(F.array(text))


def _spans(parts: Column, kind: int, ok) -> Column:
    """array<struct<start, kind, end>> of the matches that ``ok`` accepts."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), none.alias("found"))
    whole = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x)
        found = F.when(acc["hit"] & ok(x), F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), F.lit(kind).alias("kind"), end.alias("end"))))).otherwise(acc["found"])
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), found.alias("found"))

    def moved(acc: Column, group: Column) -> Column:
        """The spans so far and a group's, by its place in the text."""
        here = F.transform(group["found"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + group["at"]).alias("at"), F.concat(acc["found"], here).alias("found"))

    # an array that grows by one is copied each time, so parts are gone through in groups
    last = F.floor((F.size(parts) - 1) / GROUP).cast("int")
    groups = F.transform(F.sequence(F.lit(0), last), lambda g: F.aggregate(F.slice(parts, g * GROUP + 1, F.lit(GROUP)), begin, step))
    return F.when(F.size(parts) > 1, F.aggregate(groups, whole, moved, lambda acc: acc["found"])).otherwise(none)


def _masked(parts: Column, ok) -> Column:
    """The text with accepted matches overwritten by as many FILL."""
    hide = F.transform(parts, lambda x, i: F.when((i % 2 == 1) & ok(x), F.repeat(F.lit(FILL), F.length(x))).otherwise(x))
    return F.when(F.size(parts) > 1, F.array_join(hide, "")).otherwise(parts[0])


def _value_long(x: Column) -> Column:
    return F.length(F.regexp_extract(x, ASSIGN, 2)) >= 12


def _always(x: Column) -> Column:
    return F.lit(True)


OK = {"assign": _value_long, "access": _always, "hex": _always}


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), OPEN + CLOSE, FILL + FILL)
    row = ["row"] if "row" in docs.columns and dict(docs.dtypes)["row"].startswith("struct") else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"), *row)


def base_spans(rows: DataFrame) -> DataFrame:
    """Adds the spans of each base kind and ``masked``, the text without them."""
    for k, (kind, pattern) in enumerate(BASE):
        rows = rows.withColumn(f"p_{kind}", _parts(F.col("t"), pattern))
        rows = rows.withColumn(kind, _spans(F.col(f"p_{kind}"), k, OK[kind])).drop(f"p_{kind}")
    hit = F.size("assign") + F.size("access") + F.size("hex") > 0
    rows = rows.withColumn("masked", F.col("t"))
    for kind, pattern in BASE:
        rows = rows.withColumn("p", F.when(hit, _parts(F.col("masked"), pattern)).otherwise(F.array("masked"))).withColumn("masked", _masked(F.col("p"), OK[kind])).drop("p")
    return rows


def _characters(w: Column) -> Column:
    return F.filter(F.split(w, ""), lambda x: F.length(x) > 0)


def _with_previous(items: Column, first: Column, pair) -> Column:
    """``pair`` of each item of an array that isn't empty and the one before it; one pass over the array."""
    return F.zip_with(F.concat(F.array(first), F.slice(items, 1, F.size(items) - 1)), items, pair)


def _bigrams(words: DataFrame) -> DataFrame:
    """(pair, n): how many distinct strings' positions hold each pair of characters; strings start with "^"."""
    pairs = _with_previous(_characters(F.col("w")), F.lit("^"), lambda a, b: F.concat(a, b))
    return words.where("length(w) > 0").distinct().select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[float]:
    """Log-ratio, random over ordinary, of every pair of ASCII codes: index 128 * first + second."""
    order = F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    last = docs.select(order.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return [0.0] * (128 * 128)
    rows = base_spans(_prepared(docs.where(order <= F.lit(last)).select(id_col, text_col).distinct(), id_col, text_col))
    spans = F.concat("assign", "access", "hex")
    secret = rows.select(F.explode(spans).alias("s"), "t").select(F.regexp_extract(F.expr("substring(t, s.start + 1, s.end - s.start)"), r"([A-Za-z0-9+/_.=-]+)$", 1).alias("w"), F.col("s.kind").alias("kind"))
    secret = secret.select(F.when(F.col("kind") == 0, F.regexp_replace("w", r"^.*[:=](?=.{12})", "")).otherwise(F.col("w")).alias("w"))
    plain = rows.select(F.explode(F.regexp_extract_all("masked", F.lit(f"({WORD})"))).alias("w"))
    counts = []
    for words in (secret, plain):
        counts.append({r["pair"]: r["n"] for r in _bigrams(words).where(F.col("pair").rlike(f"^[\\^{ALPHABET[:-1]}-][{ALPHABET[:-1]}-]$")).collect()})  # at most 67 * 66 rows
    uniform = [{}, {}]
    for model, count in zip(uniform, counts, strict=True):
        for a in "^" + ALPHABET:
            total = sum(count.get(a + b, 0) for b in ALPHABET)
            # random strings lean to the uniform prior: half of their mass
            for b in ALPHABET:
                p = (count.get(a + b, 0) + PRIOR / 2) / (total + PRIOR / 2 * len(ALPHABET))
                model[a, b] = 0.5 * p + 0.5 / len(ALPHABET) if model is uniform[0] else p
    table = [0.0] * (128 * 128)
    if not counts[1]:
        return table
    for (a, b), p in uniform[0].items():
        table[128 * ord(a) + ord(b)] = round(math.log(p / uniform[1][a, b]), 6)
    return table


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[float] | None = None, least: float = LEAST_LLR) -> DataFrame:
    """doc_id, t and an array of spans for each kind."""
    table = table if table is not None else train(docs, id_col, text_col)
    ratios = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")  # folded to a constant

    def odd(x: Column) -> Column:
        codes = F.transform(_characters(x), F.ascii)
        each = _with_previous(codes, F.lit(ord("^")), lambda a, b: F.element_at(ratios, a * 128 + b + 1))
        return F.aggregate(each, F.lit(0.0), lambda acc, r: acc + r) >= F.lit(least)

    rows = base_spans(_prepared(docs, id_col, text_col))
    return rows.withColumn("p", _parts(F.col("masked"), CANDIDATE)).withColumn("random", _spans(F.col("p"), 3, odd)).drop("p", "masked")


def _joined(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and spans of every document."""
    rows = scan(docs, id_col, text_col)
    size = lambda c: F.size(c).cast("long")
    return rows.select(
        "doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"),
        F.sha2(_joined(F.concat("assign", "access", "hex")), 256).alias("base_sha256"), _joined(F.concat(*KINDS)).alias("spans"),
    )


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The documents with every span's text replaced, all columns kept; n_chars, if there, follows the text."""
    table = train(docs, id_col, text_col)
    # scan() reads one id and one text column, so the row rides along as a struct
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    rows = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), whole), table=table)
    spans = F.array_sort(F.concat(*KINDS))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    n = F.size("assign") + F.size("access") + F.size("hex") + F.size("random")
    new = F.when(n > 0, clean).otherwise(F.col("row")[text_col])
    rows = rows.select("row", new.alias("__new"))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col("__new").alias(c))
        elif c == "n_chars":
            out.append(F.length("__new").cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col("row")[c].alias(c))
    return rows.select(*out)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(C.table(spark, sf_dir, "documents"))
