"""Sources: note folders, JSON documents and tables, all read by Spark."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Stored bytes, as Spark estimates them, of a part.
PART_BYTES = 2 << 20


def parts(df: DataFrame) -> int:
    """Partitions for a frame on tables: one for each PART_BYTES that Spark estimates for its columns as stored, and at least those that are set."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, -(-n // PART_BYTES)) if n < 1 << 50 else least  # beyond that, it is a guess


def notes(spark: SparkSession, folder: str, ignore: list[str] = (), translations: bool = True) -> DataFrame:
    """path, name, parent, raw of every .md file below a folder; an unreadable folder is empty.

    ignore: regular expressions of paths to leave out. translations=False leaves out
    the siblings name.it.md, name.en.md and name.la.md.
    """
    try:
        df = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(folder, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, name string, parent string, raw string")
    path = F.regexp_replace("_metadata.file_path", "^file:/+", "/")
    df = df.select(path.alias("path"), F.regexp_extract("_metadata.file_name", r"^(.*)\.md$", 1).alias("name"), F.regexp_extract(path, "([^/]+)/[^/]+$", 1).alias("parent"), F.col("value").alias("raw"))
    for pattern in ignore:
        df = df.where(~F.col("path").rlike(pattern))
    return df if translations else df.where(~F.col("path").rlike(r"\.(it|en|la)\.md$"))


def subfolders(df: DataFrame) -> DataFrame:
    """Distinct parent folders of scanned notes."""
    return df.select("parent").distinct()


def vocabulary(spark: SparkSession, path: str, keys: dict[str, str]) -> DataFrame:
    """Nodes of a vocabulary document {list name: [node, ...]}, united, with their type.

    keys: list name -> type. Lists that the document lacks give no rows.
    """
    doc = spark.read.json(path, multiLine=True)
    parts = [doc.select(F.explode(k).alias("n")).select("n.*").withColumn("type", F.lit(t)) for k, t in keys.items() if k in doc.columns and isinstance(doc.schema[k].dataType, T.ArrayType)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON source that may be missing: then an empty frame; other errors stay errors."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def keyed_json(spark: SparkSession, folder: str, value: str = "map<string,array<string>>") -> DataFrame:
    """key (file name), entry, value of a folder of JSON objects, one row per entry."""
    df = spark.read.text(f"{folder}/*.json", wholetext=True)
    key = F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1)
    return df.select(key.alias("key"), F.explode(F.from_json("value", f"map<string,{value}>")).alias("entry", "value"))


def latest_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in the given order."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("__r")).select(key, "__r.*")


def content_index(spark: SparkSession, path: str) -> DataFrame:
    """slug and entry of a content index; {"content": {...}} is unwrapped."""
    entry = "struct<title:string,tags:array<string>,links:array<string>,content:string>"
    raw = spark.read.text(path, wholetext=True)
    inner = F.get_json_object("value", "$.content")
    nested = inner.startswith("{") & F.get_json_object("value", "$.content.slug").isNull()
    return raw.select(F.explode(F.from_json(F.when(nested, inner).otherwise(F.col("value")), f"map<string,{entry}>")).alias("slug", "e")).select("slug", "e.*")


def shard(spark: SparkSession, folder: str, key: str, value: str) -> DataFrame:
    """One shard of a partitioned sink, read by partition pruning; an unknown key is empty."""
    return spark.read.parquet(folder).where(F.col(key) == value)


def choose(small: DataFrame | None, full: DataFrame, prefer_small: bool) -> DataFrame:
    """The small source where asked for and present, else the full one."""
    return small if prefer_small and small is not None else full


def first_config(candidates: list[str], exists) -> str | None:
    """The first candidate path that exists, in order of precedence."""
    return next((c for c in candidates if exists(c)), None)


class Memo:
    """A frame loaded and cached at its first use."""

    def __init__(self, load) -> None:
        self.load, self.df = load, None

    def get(self) -> DataFrame:
        if self.df is None:
            self.df = self.load().cache()
        return self.df


def glob_pattern(pattern: str) -> str:
    """A glob (**, *, ?) as a regular expression for path filters."""
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", pattern)
    rules = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(rules.get(p, re.escape(p)) for p in parts) + "$"
