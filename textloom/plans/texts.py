"""Queries on texts: terms, TF-IDF, indexes, links, surfaces, slugs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import tfidf, vocab, works
from textloom.sources.readers import table
from textloom.sources.sinks import small_index


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


CLEAN = r"""regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(text, '\[\[(?:[^\]|]+\|)?([^\]]+)\]\]', ' \1 ', 'g'), '\[[^\]]*\]\([^)]*\)', ' ', 'g'), '[`*_>#|]', ' ', 'g')), '[^a-zà-ÿ\s]', ' ', 'g')"""
TF = f"""every AS (SELECT doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT doc_id, regexp_split_to_array({CLEAN}, '\\s+') AS ws FROM documents)),
toks AS (SELECT * FROM every WHERE length(term) >= 3 AND NOT list_contains({_list(T.STOPWORDS)}, term)),
tf AS (SELECT doc_id, term, count(*) AS tf, min(pos) AS first_pos FROM toks GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
ranked AS (SELECT doc_id, term, tf, first_pos, tf * ln((SELECT count(*) FROM documents) / df) AS score FROM tf JOIN dfs USING (term) WHERE df < (SELECT count(*) FROM documents)),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, first_pos) AS rank FROM ranked)"""


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text")


def term_freq(s, d):
    return tfidf.term_frequencies(_docs(s, d), "doc_id", T.words(F.col("text")), T.STOPWORDS)


def doc_freq(s, d):
    return tfidf.document_frequencies(term_freq(s, d))


def tfidf_topk(s, d):
    out = tfidf.keywords(_docs(s, d), "doc_id", "text", 40)
    return out.select("doc_id", "term", "tf", F.round("score", 6).alias("score"), "rank")


def tfidf_snippet_index(s, d):
    return tfidf.compressed_index(_docs(s, d), "doc_id", "text")


SNIPPET_SQL = f"""WITH every AS (SELECT doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z'']+') AS ws FROM documents)),
toks AS (SELECT * FROM every WHERE length(term) >= 3 AND NOT list_contains({_list(T.INDEX_STOPWORDS)}, term)),
tf AS (SELECT doc_id, term, count(*) AS tf, min(pos) AS first_pos FROM toks GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
ranked AS (SELECT doc_id, term, first_pos, tf * ln((SELECT count(*) FROM documents) / df) AS score FROM tf JOIN dfs USING (term) JOIN documents USING (doc_id)
  WHERE df < (SELECT count(*) FROM documents) AND NOT list_contains(regexp_extract_all(lower(substr(text, 1, 160)), '[a-z][a-z'']+'), term)),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, first_pos) AS rank FROM ranked),
best AS (SELECT doc_id, string_agg(term, ' ' ORDER BY rank) AS terms FROM top WHERE rank <= 50 GROUP BY doc_id)
SELECT doc_id, coalesce(substr(text, 1, 160), '') || coalesce(' ' || terms, '') AS content FROM documents LEFT JOIN best USING (doc_id)"""


def inverted_index(s, d):
    pairs = tfidf_topk(s, d).select("term", "doc_id").union(table(s, d, "documents").select(F.lower("source").alias("term"), "doc_id")).distinct()
    out = tfidf.postings(pairs, "term", "doc_id")
    return out.select("term", "block", F.size("keys").cast("long").alias("n_docs"), F.array_join("keys", ",").alias("docs"))


INVERTED_SQL = f"""WITH {TF}, pairs AS (SELECT term, doc_id FROM top WHERE rank <= 40 UNION SELECT lower(source), doc_id FROM documents)
SELECT term, doc_id // 4096 AS block, count(*) AS n_docs, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS docs FROM pairs GROUP BY ALL"""


def word_count(s, d):
    docs = _docs(s, d).select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), T.count_words(F.col("text")).alias("words"))
    pages = table(s, d, "pages").select(F.lit("pages").alias("kind"), F.col("page_id").alias("id"), T.count_words(F.col("html")).alias("words"))
    return docs.unionByName(pages)


def slugify(s, d):
    return table(s, d, "part").select("p_partkey", T.url_slug(F.concat_ws("/", "p_type", "p_name")).alias("slug"), T.prettify(F.regexp_replace("p_name", " ", "_")).alias("plain"), T.pretty(F.lower("p_name")).alias("shown"))


def html_escape(s, d):
    return table(s, d, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"))


SURFACES = [("the of", "s1", False), ("the", "s2", False), ("des", "s3", False), ("les", "s3", False), ("das", "s4", False), ("and", "s5", True), ("erha", "s6", False)]
SURFACE_VALUES = ", ".join(f"('{a}', '{b}', {str(c).upper()})" for a, b, c in SURFACES)


def surface_match(s, d):
    surfaces = s.createDataFrame(SURFACES, "surface string, id string, cap boolean")
    return vocab.mentions(_docs(s, d), "doc_id", "text", surfaces).select("doc_id", "id")


# "the of" holds "the" and comes first, so plain "the" is counted where no "of" follows
SURFACE_SQL = r"""WITH x AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '([^\p{L}\p{N}_-])', '\1\1', 'g'), '(?i)(?:^|[^\p{L}\p{N}_-])(the\s\sof|the|des|les|das|and|erha)(?:$|[^\p{L}\p{N}_-])', 1) AS f FROM documents),
m AS (SELECT doc_id, unnest(f) AS found FROM x)
SELECT DISTINCT doc_id, CASE lower(found) WHEN 'the  of' THEN 's1' WHEN 'the' THEN 's2' WHEN 'des' THEN 's3' WHEN 'les' THEN 's3' WHEN 'das' THEN 's4' WHEN 'and' THEN 's5' WHEN 'erha' THEN 's6' END AS id
FROM m WHERE (lower(found) <> 'and' OR regexp_matches(found, '^\p{Lu}')) AND lower(found) IN ('the  of','the','des','les','das','and','erha')"""


def link_extract(s, d):
    pages = table(s, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("pos", "href"))
    return pages.select("page_id", F.col("pos").cast("long").alias("pos"), "href")


def search_encoder(s, d):
    docs = table(s, d, "documents").select("doc_id", T.search_tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def cleaned_chars(s, d):
    """Digest of each cleaned text without its white space."""
    return table(s, d, "documents").select("doc_id", F.md5(F.encode(F.regexp_replace(T.cleaned(F.col("text")), r"\s", ""), "UTF-8")).alias("digest"))


def label_index(s, d):
    nation = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tagged = table(s, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.array("n_name", "r_name").alias("labels"))
    out = vocab.label_pairs(tagged, "c_custkey", F.col("labels"))
    return out.groupBy("term").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


LABEL_SQL = f"""WITH t AS (SELECT c_custkey, unnest([n_name, r_name]) AS label FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
w AS (SELECT c_custkey, lower(trim(label)) AS term FROM t UNION SELECT c_custkey, unnest(list_filter(regexp_split_to_array(lower(label), '[^a-zà-ÿ]+'), lambda w: length(w) >= 3 AND NOT list_contains({_list(T.STOPWORDS)}, w))) FROM t)
SELECT term, count(*) AS n, min(c_custkey) AS first FROM w WHERE term <> '' GROUP BY term"""


def small_content_index(s, d):
    docs = table(s, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("slug"), F.col("source").alias("title"), F.array("lang").alias("tags"), F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: i + F.col("doc_id")).alias("links"), F.col("text").alias("content"))
    return small_index(docs).select("slug", "title", F.array_join("tags", ",").alias("tags"), F.array_join("links", ",").alias("links"), "content")


def source_lines(s, d):
    docs = table(s, d, "documents")
    return docs.select("doc_id", works.source_line(F.when(F.col("doc_id") % 3 == 0, F.col("source")), F.when(F.col("doc_id") % 2 == 0, F.lit("A & B")), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 100 + 1800), F.col("lang")).alias("line"))


SOURCE_SQL = """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source END AS tr, concat_ws(', ', CASE WHEN doc_id % 2 = 0 THEN 'A & B' END, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 100 + 1800)::VARCHAR END) AS ed,
CASE lang WHEN 'en' THEN 'inglese' WHEN 'de' THEN 'tedesco' WHEN 'fr' THEN 'francese' WHEN 'es' THEN 'spagnolo' END AS name FROM documents),
y AS (SELECT doc_id, concat_ws(' · ', CASE WHEN tr IS NOT NULL THEN 'Traduzione di ' || tr WHEN name IS NOT NULL THEN 'Testo originale ' || name END, nullif(ed, '')) AS bits FROM x)
SELECT doc_id, CASE WHEN bits <> '' THEN '<p class="work-source">' || replace(bits || ' · pubblico dominio', '&', '&amp;') || '</p>' ELSE '' END AS line FROM y"""

SLUG_SQL = r"""SELECT p_partkey, regexp_replace(lower(regexp_replace(replace(replace(regexp_replace(p_type || '/' || p_name, '\s', '-', 'g'), '&', '-and-'), '%', '-percent'), '[?#]', '', 'g')), '/$', '') AS slug,
trim(replace(replace(p_name, ' ', '_'), '_', ' ')) AS plain, upper(substr(lower(p_name), 1, 1)) || substr(lower(p_name), 2) AS shown FROM part"""
ESC_SQL = """SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM pages"""
WC_SQL = r"""SELECT 'documents' AS kind, doc_id AS id, len(regexp_extract_all(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\S+'))::BIGINT AS words FROM documents
UNION ALL SELECT 'pages', page_id, len(regexp_extract_all(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\S+'))::BIGINT FROM pages"""

QUERIES = {
    "term_freq": (term_freq, f"WITH {TF} SELECT doc_id, term, tf, first_pos FROM tf"),
    "doc_freq": (doc_freq, f"WITH {TF} SELECT term, df FROM dfs"),
    "tfidf_topk": (tfidf_topk, f"WITH {TF} SELECT doc_id, term, tf, round(score, 6) AS score, rank FROM top WHERE rank <= 40"),
    "tfidf_snippet_index": (tfidf_snippet_index, SNIPPET_SQL),
    "inverted_index": (inverted_index, INVERTED_SQL),
    "word_count": (word_count, WC_SQL),
    "slugify": (slugify, SLUG_SQL),
    "html_escape": (html_escape, ESC_SQL),
    "surface_match": (surface_match, SURFACE_SQL),
    "link_extract": (link_extract, """SELECT page_id, (generate_subscripts(h, 1) - 1)::BIGINT AS pos, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)"""),
    "search_encoder": (search_encoder, r"""SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, regexp_extract_all(lower(text), '([\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{20000}-\x{2A6DF}]|[^ \t\r\n\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{20000}-\x{2A6DF}]+)') AS t FROM documents)"""),
    "cleaned_chars": (cleaned_chars, rf"SELECT doc_id, md5(regexp_replace({CLEAN}, '\s', '', 'g')) AS digest FROM documents"),
    "label_index": (label_index, LABEL_SQL),
    "small_content_index": (small_content_index, "SELECT source || '/' || doc_id AS slug, source AS title, lang AS tags, array_to_string(list_transform(range(1, 21), lambda i: i + doc_id), ',') AS links, substr(text, 1, 80) AS content FROM documents"),
    "source_lines": (source_lines, SOURCE_SQL),
}
