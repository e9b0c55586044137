"""Queries of the library's operators over the driver's tables, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import text as T
from skarn.lexicon import Lexicon
from skarn.operators import answer, chunking, extract, facts, graph, search
from skarn.sources import files, store
from skarn.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The tables hold no Cyrillic, so entity queries use words that their texts do hold.
WORDS = Lexicon(keywords={"Material": ["ore", "nd", "tion"], "Process": ["and", "ing"], "Equipment": ["mill", "ther"], "Parameter": ["with", "for"]}, synonyms={"motion": ["tion"], "adding": ["ing"]}, units=["%", "mg/l", "x", "th"])


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- documents ---


@query("""
SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\\x{0400}-\\x{04ff}]', '', 'g')) > 0.5 * length(regexp_replace(text, '[^A-Za-z]', '', 'g')) THEN 'ru' ELSE 'en' END AS language,
  CASE WHEN h AND f THEN 'Global' WHEN h THEN 'Russia' WHEN f THEN 'Foreign' ELSE 'Unknown' END AS geography,
  CAST(nullif(regexp_extract(substr(text, 1, 3000), '(20[0-2][0-9]|19[89][0-9])', 1), '') AS INTEGER) AS year,
  length(trim(text, E' \\n\\t\\r')) >= 100 AS long_enough, substr(md5(CAST(doc_id AS VARCHAR)), 1, 16) AS id
FROM (SELECT *, regexp_matches(lower(text), 'russia|nornickel') AS h, regexp_matches(lower(text), 'australia|canada|chile|new caledonia|finland|china|japan|usa|zambia|congo') AS f FROM documents)""")
def doc_metadata(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", T.language("text").alias("language"), T.geography("text").alias("geography"), T.year("text").alias("year"), (F.length(T.strip("text")) >= 100).alias("long_enough"), T.doc_id(F.col("doc_id").cast("string")).alias("id"))


@query("""
SELECT doc_id, substr(coalesce(list_filter(list_filter(list_transform(string_split(substr(text, 1, 2000), chr(10)), lambda x: trim(x, E' \\t\\r')), lambda x: x <> '')[1:15],
  lambda x: length(x) > 15 AND NOT regexp_matches(lower(x), '^(www\\.|http|issn|doi)'))[1], 'doc-' || doc_id), 1, 200) AS title FROM documents""")
def title_guess(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.title("text", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("title"))


@query("""
SELECT doc_id, CAST(len(l) AS BIGINT) AS n, CAST(len(list_distinct(l)) AS BIGINT) AS n_distinct
FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[а-яёa-z0-9]+'), lambda x: length(x) > 1) AS l FROM documents)""")
def token_stats(spark, sf):
    tokens = F.transform(F.array(T.tokens("text")), lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("n_distinct")))[0]
    return t(spark, sf, "documents").select("doc_id", tokens.alias("s")).select("doc_id", "s.*")


@query("""
SELECT md5, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, md5(lower(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS md5 FROM documents) GROUP BY md5""")
def dedupe_md5(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.content_md5("text").alias("md5")).groupBy("md5").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT doc_id, repeat('★', s) || repeat('☆', 5 - s) AS stars, CASE WHEN c >= 0.8 THEN 'высокая' WHEN c >= 0.5 THEN 'средняя' ELSE 'низкая' END AS label
FROM (SELECT doc_id, CAST(doc_id % 6 AS INTEGER) AS s, (doc_id % 10) / 10.0 AS c FROM documents)""")
def labels_of_trust(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.trust_stars(F.col("doc_id") % 6).alias("stars"), T.confidence_label((F.col("doc_id") % 10) / 10.0).alias("label"))


@query("""
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE WHEN term = 'ni' THEN 'никель' WHEN term = 'cu' THEN 'медь' WHEN term = 'co' THEN 'кобальт' ELSE trim(raw) END AS canonical
FROM (SELECT p_partkey, raw, lower(trim(raw)) AS term FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' Ni ' WHEN 1 THEN 'CU' WHEN 2 THEN 'co' ELSE p_brand END AS raw FROM part))""")
def term_normalisation(spark, sf):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, " Ni ").when(k == 1, "CU").when(k == 2, "co").otherwise(F.col("p_brand"))
    return t(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), T.normalize_term(raw).alias("canonical"))


@query("""
SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(list_filter(list_transform(string_split(substr(text, 1, 1500), chr(10)), lambda x: trim(x, E' \\t\\r')), lambda x: x <> '')[1:5],
  lambda x: CASE WHEN length(x) < 300 THEN list_concat(regexp_extract_all(x, '[А-ЯЁ][а-яё]+\\s+[А-ЯЁ]\\.?(?:\\s*[А-ЯЁ]\\.?)?')[1:10], regexp_extract_all(x, '[A-Z][a-z]+\\s+[A-Z]\\.?(?:\\s*[A-Z]\\.?)?')[1:10]) ELSE [] END),
  lambda a: len(a) > 0)[1][1:10], '|'), '') AS authors FROM documents""")
def authors(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.array_join(T.authors("text"), "|").alias("authors"))


_CHUNKED = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\\n{3,}', E'\\n\\n', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM SOURCE),
c(doc_id, a, e) AS (SELECT doc_id, 0, CAST(0 AS BIGINT) FROM d WHERE t <> '' UNION ALL
SELECT doc_id, a, CASE WHEN a + 1200 >= n THEN n WHEN s1 > 0 THEN a + 1000 + s1 WHEN s2 > 0 THEN a + 1000 + s2 WHEN s3 > 0 THEN a + 1000 + s3 ELSE a + 1200 END FROM (
SELECT doc_id, a, n, length(regexp_extract(w, '(?s)^.*[.!?]\\s+')) AS s1, length(regexp_extract(w, '(?s)^.*\\n\\n')) AS s2, length(regexp_extract(w, '(?s)^.*\\n')) AS s3
FROM (SELECT d.doc_id, b.a, length(t) AS n, substr(t, b.a + 1001, 250) AS w FROM (SELECT doc_id, CAST(CASE WHEN e = 0 THEN 0 ELSE e - 200 END AS INTEGER) AS a, e FROM c) b JOIN d ON d.doc_id = b.doc_id WHERE b.e < length(t)))),
p AS (SELECT c.doc_id, a, CASE WHEN e = length(t) AND a + 1200 >= length(t) THEN substr(t, a + 1) ELSE regexp_replace(substr(t, a + 1, e - a), '^\\s+|\\s+$', '', 'g') END AS text FROM c JOIN d ON c.doc_id = d.doc_id WHERE e > 0),
r AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS idx, text FROM p WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 50)
"""
_CHUNKS = _CHUNKED.replace("SOURCE", "documents")


@query(_CHUNKS + "SELECT printf('%d_%04d', doc_id, idx) AS id, doc_id, idx, CAST(NULL AS INTEGER) AS page, text FROM r")
def chunks(spark, sf):
    return chunking.chunk_pages(t(spark, sf, "documents").select("doc_id", F.array("text").alias("pages")))


@query(
    # pages as documents of their own, then one numbering over the pages of a document
    _CHUNKED.replace("SOURCE", "(SELECT doc_id * 2 AS doc_id, text FROM documents UNION ALL SELECT doc_id * 2 + 1, 'Second page of ' || doc_id || '. ' || substr(text, 1, 2000) FROM documents WHERE doc_id % 3 = 0)")
    + """, o AS (SELECT doc_id // 2 AS doc_id, doc_id % 2 + 1 AS page, text, CAST(row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id % 2, idx) - 1 AS INTEGER) AS idx FROM r)
SELECT printf('%d_%04d', doc_id, idx) AS id, doc_id, idx, CAST(CASE WHEN doc_id % 3 = 0 THEN page END AS INTEGER) AS page, text FROM o"""
)
def chunk_pages(spark, sf):
    second = F.concat(F.lit("Second page of "), F.col("doc_id").cast("string"), F.lit(". "), F.substring("text", 1, 2000))
    pages = F.when(F.col("doc_id") % 3 == 0, F.array(F.col("text"), second)).otherwise(F.array("text"))
    return chunking.chunk_pages(t(spark, sf, "documents").select("doc_id", pages.alias("pages")))


# --- search ---


def _term_index(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.term_stats(search.postings(d), d.count()).select("term", "df", F.round("idf", 6).alias("idf"))


_BM25 = """
WITH tok AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[а-яёa-z0-9]+'), lambda x: length(x) > 1) AS l FROM documents),
q AS (SELECT * FROM (VALUES ('the'), ('and'), ('there')) v(term)), s AS (SELECT count(*) AS n, greatest(avg(len(l)), 1) AS a FROM tok),
tf AS (SELECT id, len(l) AS dl, term, len(list_filter(l, lambda x: x = term)) AS tf FROM tok, q), df AS (SELECT term, count(*) AS d FROM tf WHERE tf > 0 GROUP BY term),
hit AS (SELECT id, round(sum(ln((n - d + 0.5) / (d + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / a))), 6) AS score FROM tf JOIN df USING (term), s WHERE tf > 0 GROUP BY id)
"""


@query(_BM25 + "SELECT id AS doc_id, score FROM hit ORDER BY score DESC, id LIMIT 10")
def bm25_topk(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    top = search.bm25(d, "the and there", 50)
    return top.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query("""
SELECT term, CAST(count(*) AS BIGINT) AS df, round(ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf
FROM (SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[а-яёa-z0-9]+'), lambda x: length(x) > 1)) AS term FROM documents) GROUP BY term""")
def term_index(spark, sf):
    return _term_index(spark, sf)


@query(ORACLES["term_index"])
def term_index_all(spark, sf):
    return _term_index(spark, sf)


_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE)))"


@query(f"SELECT e.vec_id, round({_DOT}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_DOT} DESC, vec_id LIMIT 10")
def vector_topk(spark, sf):
    e = t(spark, sf, "embeddings")
    q = e.where("vec_id = 0").first().embedding
    return search.vector_topk(e, q, 10, "vec_id").select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(
    _BM25
    + f""", b AS (SELECT id, score FROM hit ORDER BY score DESC, id LIMIT 20), v AS (SELECT e.vec_id AS id, {_DOT} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, id LIMIT 20)
SELECT coalesce(b.id, v.id) AS id, round(0.4 * coalesce(b.score / (SELECT greatest(max(score), 1e-9) FROM b), 0) + 0.6 * coalesce(v.score / (SELECT greatest(max(score), 1e-9) FROM v), 0), 4) AS score
FROM b FULL OUTER JOIN v ON b.id = v.id"""
)
def hybrid_topk(spark, sf):
    e = t(spark, sf, "embeddings")
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    text = search.bm25(d, "the and there", 60).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id").limit(20)
    return search.combined(text, search.vector_topk(e, e.where("vec_id = 0").first().embedding, 20, "vec_id")).select("id", F.round("score", 4).alias("score"))


@query("SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE (year(o_orderdate) >= 1995 AND year(o_orderdate) <= 1996 OR o_orderkey % 7 = 0) AND o_orderstatus IN ('F', 'O')")
def filter_null_pass(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, F.year("o_orderdate")).alias("year"), F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("category"))
    return o.where(search.matches({"category": ["F", "O"], "year_from": 1995, "year_to": 1996, "unknown": 1})).select("id", F.col("y").alias("year"))


@query("SELECT doc_id AS id, year, lang AS category FROM (SELECT *, CAST(1990 + doc_id % 30 AS INTEGER) AS year FROM documents) WHERE lang = 'en' AND year >= 2000 ORDER BY year DESC, doc_id LIMIT 50")
def documents_list(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), (1990 + F.col("doc_id") % 30).cast("int").alias("year"))
    return search.listed(d, category="en", year_from=2000)[0]


# --- entities ---

_LEX = "(VALUES (0, 'Material', 'ore', 'ore'), (1, 'Material', 'nd', 'nd'), (2, 'Material', 'tion', 'motion'), (3, 'Process', 'and', 'and'), (4, 'Process', 'ing', 'adding'), (5, 'Equipment', 'mill', 'mill'), (6, 'Equipment', 'ther', 'ther'), (7, 'Parameter', 'with', 'with'), (8, 'Parameter', 'for', 'for')) l(ord, type, name, canonical)"


@query(f"SELECT doc_id, type, name, canonical FROM documents, {_LEX} WHERE contains(lower(text), name)")
def keyword_entities(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.inline(extract.keyword_mentions(F.col("text"), WORDS))).select("doc_id", "type", "name", "canonical")


_VALUES = f"""(SELECT doc_id, k, CASE WHEN contains(b, 'with') THEN 'with' WHEN contains(b, 'for') THEN 'for' ELSE 'parameter_' || unit END AS name, low AS value_low, coalesce(high, low) AS value_high, unit FROM (
SELECT doc_id, CAST(i // 2 - 1 AS INTEGER) AS k, lower(right(array_to_string(list_transform(p[1:i - 1], lambda x: split_part(x, chr(57345), 1)), ''), 50)) AS b, split_part(p[i], chr(57345), 4) AS unit,
  CAST(replace(split_part(p[i], chr(57345), 2), ',', '.') AS DOUBLE) AS low, CAST(nullif(replace(split_part(p[i], chr(57345), 3), ',', '.'), '') AS DOUBLE) AS high
FROM (SELECT doc_id, p, unnest(generate_series(2, len(p), 2)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '(?:<=|>=|<|>|≥|≤|≈|~)?\\s*([0-9]+(?:[.,][0-9]+)?)\\s*(?:[-–—]\\s*([0-9]+(?:[.,][0-9]+)?)\\s*)?(mg/l|th|%|x)',
  chr(57344) || '\\0' || chr(57345) || '\\1' || chr(57345) || '\\2' || chr(57345) || '\\3' || chr(57344), 'gi'), chr(57344)) AS p FROM documents))))"""
_MENTIONS = f"""
WITH e AS (SELECT doc_id, ord, type, name, canonical, CAST(NULL AS DOUBLE) AS value_low, CAST(NULL AS DOUBLE) AS value_high, CAST(NULL AS VARCHAR) AS unit FROM documents, {_LEX} WHERE contains(lower(text), name)
UNION ALL SELECT doc_id, 100000 + k, 'Parameter', name, name, value_low, value_high, unit FROM {_VALUES}),
m AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, type, canonical ORDER BY ord) = 1),
r AS (SELECT p.doc_id, CAST(row_number() OVER (PARTITION BY p.doc_id ORDER BY p.ord, o.ord) - 1 AS INTEGER) AS ord, p.canonical AS src, o.canonical AS dst, o.type AS dst_type,
  CASE o.type WHEN 'Material' THEN 'uses_material' WHEN 'Equipment' THEN 'uses_equipment' ELSE 'has_parameter' END AS rel_type, o.value_low, o.value_high, o.unit
FROM m p JOIN m o ON p.doc_id = o.doc_id WHERE p.type = 'Process' AND (o.type = 'Equipment' OR o.type = 'Material' AND o.canonical <> p.canonical OR o.type = 'Parameter' AND o.value_low IS NOT NULL))
"""


@query(f"SELECT doc_id, name, value_low, value_high, unit FROM {_VALUES}")
def numeric_values(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.inline(extract.numeric_values(F.col("text"), WORDS))).select("doc_id", "name", "value_low", "value_high", "unit")


def _chunks(spark, sf):
    return t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.lit(0).alias("idx"), "text")


@query(f"""
WITH m AS (SELECT doc_id, type, canonical FROM documents, {_LEX} WHERE contains(lower(text), name))
SELECT p.doc_id, p.canonical AS src, o.canonical AS dst, CASE o.type WHEN 'Material' THEN 'uses_material' ELSE 'uses_equipment' END AS rel_type
FROM m p JOIN m o ON p.doc_id = o.doc_id AND p.type = 'Process' AND o.type IN ('Material', 'Equipment') AND (o.type = 'Equipment' OR o.canonical <> p.canonical)""")
def cooccur_relations(spark, sf):
    c = _chunks(spark, sf)
    found = c.select(F.col("id").alias("chunk_id"), "doc_id", F.col("idx").alias("chunk_idx"), F.inline(extract.keyword_mentions(F.col("text"), WORDS)))
    return extract.relations(found, c).select("doc_id", "src", "dst", "rel_type")


@query(_MENTIONS + "SELECT CAST(doc_id AS VARCHAR) AS chunk_id, doc_id, 0 AS chunk_idx, ord, type, name, canonical, value_low, value_high, unit FROM m")
def extraction(spark, sf):
    return extract.mentions(_chunks(spark, sf), WORDS)


@query(_MENTIONS + "SELECT r.doc_id, 0 AS chunk_idx, ord, src, 'Process' AS src_type, dst, dst_type, rel_type, value_low, value_high, unit, substr(text, 1, 200) AS evidence FROM r JOIN documents d ON r.doc_id = d.doc_id")
def chunk_relations(spark, sf):
    return extract.extracted(_chunks(spark, sf), WORDS)[1]


def _extraction_graph(spark, sf):
    docs = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("path"), (1 + F.col("doc_id") % 5).cast("int").alias("trust"), F.col("lang").alias("geography"))
    return graph.extraction_evidence(*extract.extracted(_chunks(spark, sf), WORDS), docs)


@query(_MENTIONS + "SELECT type || ':' || canonical AS id, count(DISTINCT doc_id) AS n_sources, CAST(max(1 + doc_id % 5) AS INTEGER) AS trust FROM m GROUP BY ALL")
def extraction_nodes(spark, sf):
    return graph.node_table(_extraction_graph(spark, sf)[0]).select("id", "n_sources", "trust")


@query(_MENTIONS + """SELECT 'Process:' || src AS src, dst_type || ':' || dst AS dst, rel_type, count(DISTINCT doc_id) AS n_sources FROM r GROUP BY ALL
UNION ALL SELECT DISTINCT type || ':' || canonical, 'Publication:doc:' || doc_id, 'described_in', 1 FROM m""")
def extraction_edges(spark, sf):
    return graph.edge_table(_extraction_graph(spark, sf)[1]).select("src", "dst", "rel_type", "n_sources")


def _document_graph(spark, sf):
    d = t(spark, sf, "documents")
    return graph.document_evidence(d.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"), F.array("source", "lang").alias("authors"), (1 + F.col("doc_id") % 5).cast("int").alias("trust"), F.col("lang").alias("geography"), F.col("doc_id").cast("string").alias("path")))


@query("""
SELECT 'Publication:doc:' || doc_id AS id, 't' || doc_id AS name, 1 AS n_sources, CAST(1 + doc_id % 5 AS INTEGER) AS trust FROM documents UNION ALL
SELECT 'Expert:' || a, a, count(DISTINCT doc_id), CAST(max(1 + doc_id % 5) AS INTEGER) FROM (SELECT doc_id, unnest([source, lang]) AS a FROM documents) GROUP BY a""")
def document_nodes(spark, sf):
    return graph.node_table(_document_graph(spark, sf)[0].withColumn("properties", F.create_map().cast("map<string,string>"))).select("id", "name", "n_sources", "trust")


@query("SELECT DISTINCT 'Expert:' || unnest([source, lang]) AS src, 'Publication:doc:' || doc_id AS dst, 'described_in' AS rel_type, CAST(1 + doc_id % 5 AS INTEGER) AS trust FROM documents")
def document_edges(spark, sf):
    none = {c: F.lit(None).cast(k) for c, k in (("value_low", "double"), ("value_high", "double"), ("unit", "string"), ("evidence", "string"))}
    return graph.edge_table(_document_graph(spark, sf)[1].withColumns(none)).select("src", "dst", "rel_type", "trust")


@query("""
WITH f AS (SELECT *, doc_id || '-' || (1970 + doc_id % 60) || CASE WHEN doc_id % 7 = 0 THEN '-China' WHEN doc_id % 7 = 1 THEN '-Норильск' ELSE '' END || '.txt' AS filename FROM documents)
SELECT substr(md5('x/' || CASE WHEN doc_id % 2 = 0 THEN 'Обзоры' ELSE 'other' END || '/' || filename), 1, 16) AS id, filename, CASE WHEN doc_id % 2 = 0 THEN 'review' ELSE 'report' END AS category, CASE WHEN doc_id % 2 = 0 THEN 'review' ELSE 'internal_report' END AS source_type,
  CAST(coalesce(nullif(regexp_extract(filename, '(20[0-2][0-9]|19[89][0-9])', 1), ''), nullif(regexp_extract(substr(text, 1, 3000), '(20[0-2][0-9]|19[89][0-9])', 1), '')) AS INTEGER) AS year,
  CAST(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS num_pages, CAST(length(text) + CASE WHEN doc_id % 3 = 0 THEN 6 ELSE 0 END AS INTEGER) AS text_length, 4 AS trust,
  CASE WHEN h AND g THEN 'Global' WHEN h THEN 'Russia' WHEN g THEN 'Foreign' ELSE 'Unknown' END AS geography, CASE WHEN length(regexp_replace(text, '[^\\x{0400}-\\x{04ff}]', '', 'g')) > 0.5 * length(regexp_replace(text, '[^A-Za-z]', '', 'g')) THEN 'ru' ELSE 'en' END AS language
FROM (SELECT *, regexp_matches(lower(text || ' ' || filename), 'russia|nornickel|норильск') AS h, regexp_matches(lower(text || ' ' || filename), 'australia|canada|chile|new caledonia|finland|china|japan|usa|zambia|congo') AS g FROM f) WHERE length(regexp_replace(text || CASE WHEN doc_id % 3 = 0 THEN E'\n\nmore' ELSE '' END, '^\\s+|\\s+$', '', 'g')) >= 100""")
def assembled_documents(spark, sf):
    k = F.col("doc_id")
    path = F.concat(F.lit("x/"), F.when(k % 2 == 0, "Обзоры").otherwise("other"), F.lit("/"), k.cast("string"), F.lit("-"), (1970 + k % 60).cast("string"), F.when(k % 7 == 0, "-China").when(k % 7 == 1, "-Норильск").otherwise(""), F.lit(".txt"))
    pages = F.when(k % 3 == 0, F.array(F.col("text"), F.lit("more"))).otherwise(F.array("text"))
    return files.documents(t(spark, sf, "documents").select(path.alias("path"), pages.alias("pages"))).select("id", "filename", "category", "source_type", "year", "num_pages", "text_length", "trust", "geography", "language")


# --- graph over the star schema: nations and customers, suppliers and parts ---


def _evidence(spark, sf):
    line = t(spark, sf, "lineitem")
    node = line.select(F.lit("Process").alias("type"), F.col("l_suppkey").cast("string").alias("canonical"), F.concat(F.lit("s"), F.col("l_shipmode") if "l_shipmode" in line.columns else F.col("l_returnflag")).alias("name"), F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber").cast("int").alias("trust"), F.col("l_linestatus").alias("geography"), F.create_map(F.lit("q"), F.col("l_quantity").cast("string")).alias("properties"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq"))
    edge = line.select(F.concat(F.lit("Process:"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("Parameter:"), (F.col("l_partkey") % 50).cast("string")).alias("dst"), F.lit("has_parameter").alias("rel_type"), F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber").cast("int").alias("trust"), F.col("l_quantity").cast("double").alias("value_low"), F.col("l_quantity").cast("double").alias("value_high"), F.col("l_returnflag").alias("unit"), F.lit("e").alias("evidence"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq"))
    return node, edge


@query("""
SELECT 'Process:' || l_suppkey AS id, 's' || arg_min(l_returnflag, s) AS name, arg_min(l_linestatus, s) AS geography, CAST(max(l_linenumber) AS INTEGER) AS trust, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_sources, CAST(count(DISTINCT l_returnflag) AS BIGINT) AS n_names, CAST(CAST(arg_max(l_quantity, s) AS DOUBLE) AS VARCHAR) AS q
FROM (SELECT *, l_orderkey * 1000000000 + l_linenumber * 10000000 + l_partkey AS s FROM lineitem) GROUP BY l_suppkey""")
def graph_nodes(spark, sf):
    return graph.node_table(_evidence(spark, sf)[0]).select("id", "name", "geography", "trust", "n_sources", "n_names", F.col("properties")["q"].alias("q"))


@query(ORACLES["graph_nodes"])
def incremental_nodes(spark, sf):
    ev = _evidence(spark, sf)[0]
    early = F.col("seq.l_orderkey") % 3 < 2
    return graph.node_table(ev.where(early).unionByName(ev.where(~early))).select("id", "name", "geography", "trust", "n_sources", "n_names", F.col("properties")["q"].alias("q"))


@query("SELECT DISTINCT 'Process:' || l_suppkey AS id, CAST(l_orderkey AS VARCHAR) AS doc_id FROM lineitem")
def node_provenance(spark, sf):
    return graph.provenance(_evidence(spark, sf)[0])


@query("""
SELECT 'Process:' || l_suppkey AS src, 'Parameter:' || (l_partkey % 50) AS dst, CAST(max(l_linenumber) AS INTEGER) AS trust, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_sources, CAST(arg_max(l_quantity, s) AS DOUBLE) AS value_low, arg_max(l_returnflag, s) AS unit
FROM (SELECT *, l_orderkey * 1000000000 + l_linenumber * 10000000 + l_partkey AS s FROM lineitem) GROUP BY l_suppkey, l_partkey % 50""")
def graph_edges(spark, sf):
    return graph.edge_table(_evidence(spark, sf)[1]).select("src", "dst", "trust", "n_sources", "value_low", "unit")


def _star(spark, sf):
    c, n, r, s = (t(spark, sf, x) for x in ("customer", "nation", "region", "supplier"))
    node = (
        n.select(F.concat(F.lit("Nation:"), "n_nationkey").alias("id"), F.lit("Nation").alias("type"), F.col("n_name").alias("name"))
        .union(r.select(F.concat(F.lit("Region:"), "r_regionkey"), F.lit("Region"), "r_name"))
        .union(s.select(F.concat(F.lit("Supplier:"), "s_suppkey"), F.lit("Supplier"), "s_name"))
        .union(c.select(F.concat(F.lit("Customer:"), "c_custkey"), F.lit("Customer"), "c_name"))
    )
    edge = (
        n.select(F.concat(F.lit("Nation:"), "n_nationkey").alias("src"), F.concat(F.lit("Region:"), "n_regionkey").alias("dst"), F.lit("in_region").alias("rel_type"))
        .union(s.select(F.concat(F.lit("Supplier:"), "s_suppkey"), F.concat(F.lit("Nation:"), "s_nationkey"), F.lit("in_nation")))
        .union(c.select(F.concat(F.lit("Customer:"), "c_custkey"), F.concat(F.lit("Nation:"), "c_nationkey"), F.lit("in_nation")))
    )
    return node.withColumn("canonical", F.col("name")), edge


_E = "(SELECT 'Nation:' || n_nationkey AS src, 'Region:' || n_regionkey AS dst, 'in_region' AS rel_type FROM nation UNION ALL SELECT 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey, 'in_nation' FROM supplier UNION ALL SELECT 'Customer:' || c_custkey, 'Nation:' || c_nationkey, 'in_nation' FROM customer)"
_N = "(SELECT 'Nation:' || n_nationkey AS id, 'Nation' AS type, n_name AS name FROM nation UNION ALL SELECT 'Region:' || r_regionkey, 'Region', r_name FROM region UNION ALL SELECT 'Supplier:' || s_suppkey, 'Supplier', s_name FROM supplier UNION ALL SELECT 'Customer:' || c_custkey, 'Customer', c_name FROM customer)"


@query(f"SELECT 'node' AS kind, type, CAST(count(*) AS BIGINT) AS n FROM {_N} GROUP BY ROLLUP (type) UNION ALL SELECT 'edge', rel_type, CAST(count(*) AS BIGINT) FROM {_E} GROUP BY ROLLUP (rel_type)")
def graph_stats(spark, sf):
    return graph.stats(*_star(spark, sf))


@query(f"SELECT id, type, name FROM {_N} WHERE type = 'Customer' AND contains(lower(name), '12') ORDER BY id LIMIT 20")
def find_entities(spark, sf):
    return graph.find_entities(_star(spark, sf)[0], type="Customer", name="12", limit=20).select("id", "type", "name")


@query(f"""
WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM {_E} UNION ALL SELECT dst, src FROM {_E}), w(id, distance) AS (SELECT 'Region:0', 0 UNION SELECT e.b, w.distance + 1 FROM w JOIN e ON e.a = w.id WHERE w.distance < 2)
SELECT id, CAST(min(distance) AS INTEGER) AS distance FROM w GROUP BY id""")
def neighbors_bfs(spark, sf):
    return graph.neighbours(_star(spark, sf)[1], "Region:0", depth=2, limit=None)[0]


@query(f"""
WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM {_E} UNION ALL SELECT dst, src FROM {_E}), w(id, distance) AS (SELECT 'Supplier:1', 0 UNION SELECT e.b, w.distance + 1 FROM w JOIN e ON e.a = w.id WHERE w.distance < 3),
n AS (SELECT id, min(distance) AS distance FROM w GROUP BY id ORDER BY 2, 1 LIMIT 50)
SELECT src, dst, rel_type FROM {_E} WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""")
def neighborhood_edges(spark, sf):
    return graph.neighbours(_star(spark, sf)[1], "Supplier:1", depth=3, limit=50)[1]


@query(f"SELECT id, type, name FROM {_N} WHERE id = 'Nation:3'")
def get_entity(spark, sf):
    return graph.entity(_star(spark, sf)[0], "Nation:3").select("id", "type", "name")


@query("SELECT DISTINCT 'Material:' || CASE p_partkey % 4 WHEN 0 THEN 'никель' WHEN 1 THEN 'медь' WHEN 2 THEN 'кобальт' ELSE p_brand END AS id FROM part WHERE p_partkey % 4 = 1")
def entity_by_type_and_name(spark, sf):
    k = F.col("p_partkey") % 4
    term = T.normalize_term(F.when(k == 0, " Ni ").when(k == 1, "CU").when(k == 2, "co").otherwise(F.col("p_brand")))
    node = t(spark, sf, "part").select(F.lit("Material").alias("type"), term.alias("canonical")).distinct().withColumn("id", graph.node_id("type", "canonical"))
    return graph.entity_named(node, "Material", " Copper ").select("id")


@query(f"SELECT src, dst, rel_type FROM {_E} WHERE src = 'Nation:3' OR dst = 'Nation:3'")
def incident_edges(spark, sf):
    return graph.incident(_star(spark, sf)[1], "Nation:3")


@query("""
SELECT 'Parameter:' || (l_partkey % 50) AS dst, CAST(arg_max(l_quantity, s) AS DOUBLE) AS value_low
FROM (SELECT *, l_orderkey * 1000000000 + l_linenumber * 10000000 + l_partkey AS s FROM lineitem) WHERE l_suppkey = 3 GROUP BY l_partkey % 50""")
def process_chain(spark, sf):
    edge = graph.edge_table(_evidence(spark, sf)[1])
    node = edge.select(F.col("dst").alias("id"), F.lit("Parameter").alias("type"), F.col("dst").alias("canonical")).distinct()
    return graph.chain(edge, node, "3").select(F.col("target").alias("dst"), "value_low")


@query(f"SELECT src, dst, rel_type FROM {_E} e WHERE dst IN ('Nation:1', 'Nation:2') ORDER BY src, dst, rel_type LIMIT 100")
def subgraph(spark, sf):
    node, edge = _star(spark, sf)
    as_doc = edge.withColumn("dst", F.regexp_replace("dst", "^Nation:", "Publication:doc:"))
    return graph.subgraph(as_doc, node, ["1", "2"])[1].withColumn("dst", F.regexp_replace("dst", "^Publication:doc:", "Nation:"))


@query(f"""
WITH s AS (SELECT src, dst FROM {_E} e WHERE dst IN ('Nation:1', 'Nation:2') ORDER BY src, dst, rel_type LIMIT 100), i AS (SELECT src AS id FROM s UNION SELECT 'Publication:doc:' || substr(dst, 8) FROM s)
SELECT id, type, name FROM {_N} WHERE id IN (SELECT id FROM i)""")
def subgraph_nodes(spark, sf):
    node, edge = _star(spark, sf)
    return graph.subgraph(edge.withColumn("dst", F.regexp_replace("dst", "^Nation:", "Publication:doc:")), node, ["1", "2"])[0].select("id", "type", "name")


@query("""
SELECT 'Process:' || l_suppkey AS src, 'Parameter:' || (l_partkey % 50) AS dst, CAST(min(l_quantity) AS DOUBLE) AS low, CAST(max(l_quantity) AS DOUBLE) AS high, CAST(count(*) AS BIGINT) AS n
FROM lineitem GROUP BY l_suppkey, l_partkey % 50 HAVING count(*) >= 2 AND (max(l_quantity) - min(l_quantity)) / max(l_quantity) > 0.3""")
def contradictions(spark, sf):
    return graph.contradictions(_evidence(spark, sf)[1]).select("src", "dst", "low", "high", "n")


@query("""
WITH p AS (SELECT * FROM (SELECT 'Process:' || s_suppkey AS process FROM supplier) ORDER BY process LIMIT 20), m AS (SELECT * FROM (SELECT 'Material:' || p_partkey AS material FROM part) ORDER BY material LIMIT 20)
SELECT process, material FROM p, m WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE 'Process:' || l_suppkey = process AND 'Material:' || l_partkey = material) ORDER BY process, material LIMIT 50""")
def gaps(spark, sf):
    two = F.array(F.lit("a"), F.lit("b"))
    node = t(spark, sf, "supplier").select(F.concat(F.lit("Process:"), "s_suppkey").alias("id"), F.lit("Process").alias("type"), two.alias("source_ids")).union(t(spark, sf, "part").select(F.concat(F.lit("Material:"), "p_partkey"), F.lit("Material"), two))
    used = t(spark, sf, "lineitem").select(F.concat(F.lit("Process:"), "l_suppkey").alias("src"), F.concat(F.lit("Material:"), "l_partkey").alias("dst")).distinct().withColumn("rel_type", F.lit("uses_material"))
    return graph.gaps(node, used).select("process", "material")


@query("""
SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_type, ts_id) AS name FROM (SELECT *, CAST(epoch_us(ts) AS HUGEINT) * 100000 + event_id % 100000 AS ts_id FROM events) GROUP BY user_id HAVING arg_max(event_type, ts_id) <> 'click'""")
def curation_latest(spark, sf):
    e = t(spark, sf, "events")
    edits = e.select(F.col("user_id").cast("string").alias("id"), F.struct("ts", (F.col("event_id") % 100000).alias("e")).alias("at"), (F.col("event_type") == "click").alias("deleted"), F.col("event_type").alias("name"))
    rows = spark.createDataFrame([], "id string, name string")
    return graph.curated(rows, edits)


# --- facts and dashboards ---


def _facts(spark, sf):
    """Events as facts: type is the subject, value the value, half of the users' rows restricted."""
    e = t(spark, sf, "events")
    u = F.col("user_id")
    return e.select(
        F.col("event_type").alias("canon"), F.lit("value").alias("metric"), F.col("value").alias("value_low"), F.col("value").alias("value_high"), F.lit("x").alias("unit"), F.lit(None).cast("string").alias("phase"), F.lit("").alias("quote"),
        u.cast("string").alias("doc_id"), F.when(u % 3 > 0, (2000 + u % 20).cast("int")).alias("year"), ((u % 10) / 10).alias("confidence"), F.col("ts").alias("extracted_at"), F.when(u % 2 == 0, "restricted").alias("sensitivity"),
        F.when(u % 4 == 0, "RU").when(u % 4 == 1, "WORLD").alias("geo"), F.col("event_id").alias("id"),
    )


def _docs(spark, sf):
    d = t(spark, sf, "events").select("user_id").distinct()
    u = F.col("user_id")
    return d.select(u.cast("string").alias("doc_id"), F.when(u % 4 == 0, "RU").when(u % 4 == 1, "WORLD").alias("geo"), F.array(F.concat(F.lit("d"), (u % 5).cast("string"))).alias("domains"))


@query("SELECT event_id AS id FROM events WHERE (user_id % 10) / 10.0 >= 0.5 AND (user_id % 3 = 0 OR 2000 + user_id % 20 >= 2005) AND CASE user_id % 4 WHEN 0 THEN 'RU' ELSE 'WORLD' END = 'WORLD' AND contains(event_type, 'c')")
def fact_filters(spark, sf):
    return _facts(spark, sf).where(facts.passes({"min_confidence": 0.5, "year_from": 2005, "geo": ["WORLD"], "material": ["c"]})).select("id")


@query("SELECT CAST(count(*) FILTER (WHERE user_id % 2 = 1) AS BIGINT) AS visible, CAST(count(*) FILTER (WHERE user_id % 2 = 0) AS BIGINT) AS hidden_count FROM events")
def rbac_hidden(spark, sf):
    see = facts.visible("external_partner")
    return _facts(spark, sf).agg(F.count(F.when(see, 1)).alias("visible"), F.count(F.when(~see, 1)).alias("hidden_count"))


_VP = "SELECT l_suppkey AS s, l_partkey % 50 AS p, l_returnflag AS u, l_orderkey AS d, CAST(l_quantity AS DOUBLE) AS v FROM lineitem"


@query(f"""
SELECT rel, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN abs(a.v - b.v) / greatest(a.v, b.v) <= 0.1 THEN 'VALIDATED_BY' WHEN abs(a.v - b.v) / greatest(a.v, b.v) > 0.2 THEN 'CONTRADICTS' END AS rel
FROM ({_VP}) a JOIN ({_VP}) b ON a.s = b.s AND a.p = b.p AND a.u = b.u AND CAST(a.d AS VARCHAR) < CAST(b.d AS VARCHAR)) WHERE rel IS NOT NULL GROUP BY rel""")
def verify_pairs(spark, sf):
    f = t(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("metric"), (F.col("l_partkey") % 50).cast("string").alias("canon"), F.lit(None).cast("string").alias("phase"), F.col("l_returnflag").alias("unit"), F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_quantity").cast("double").alias("value_low"))
    return facts.verify_counts(f)


_CLASSES = f"""
WITH v AS (SELECT s, p, u, v, count(*) AS n, min(CAST(d AS VARCHAR)) AS lo, max(CAST(d AS VARCHAR)) AS hi FROM ({_VP}) GROUP BY s, p, u, v),
k AS (SELECT a.s, a.p, a.u, a.v AS va, b.v AS vb, a.n AS na, b.n AS nb, CASE WHEN a.lo <> b.hi THEN a.lo ELSE a.hi END AS da, CASE WHEN a.lo <> b.hi THEN b.hi ELSE b.lo END AS db,
  CASE WHEN abs(a.v - b.v) / greatest(a.v, b.v) <= 0.1 THEN 'VALIDATED_BY' WHEN abs(a.v - b.v) / greatest(a.v, b.v) > 0.2 THEN 'CONTRADICTS' END AS rel
FROM v a JOIN v b ON a.s = b.s AND a.p = b.p AND a.u = b.u WHERE a.v <= b.v AND (a.lo <> b.hi OR a.hi <> b.lo))
"""


def _line_facts(spark, sf):
    return t(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("metric"), (F.col("l_partkey") % 50).cast("string").alias("canon"), F.lit(None).cast("string").alias("phase"), F.col("l_returnflag").alias("unit"), F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_quantity").cast("double").alias("value_low"))


@query(_CLASSES + "SELECT CAST(s AS VARCHAR) AS metric, CAST(p AS VARCHAR) AS canon, u AS unit, va AS value_a, vb AS value_b, na AS n_a, nb AS n_b, da AS doc_a, db AS doc_b, rel FROM k WHERE rel IS NOT NULL")
def verify_classes(spark, sf):
    return facts.verify_classes(_line_facts(spark, sf)).drop("phase")


@query(_CLASSES + "SELECT CASE WHEN CAST(da AS BIGINT) % 3 + CAST(db AS BIGINT) % 3 = 1 THEN 'ru_vs_world' ELSE 'method_vs_method' END AS kind, count(*) AS n FROM k WHERE rel = 'CONTRADICTS' GROUP BY ALL")
def contradiction_kinds(spark, sf):
    k = F.col("o_orderkey") % 3
    docs = t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.when(k == 0, "RU").when(k == 1, "WORLD").alias("geo"))
    return facts.with_kind(facts.verify_classes(_line_facts(spark, sf)).where("rel = 'CONTRADICTS'"), docs).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(_CLASSES + "SELECT CAST(p AS VARCHAR) AS canon, count(*) AS pairs, bool_or(CAST(da AS BIGINT) % 3 + CAST(db AS BIGINT) % 3 = 1) AS ru_vs_world FROM k WHERE rel = 'CONTRADICTS' GROUP BY p")
def risk_contradictions(spark, sf):
    k = F.col("o_orderkey") % 3
    docs = t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.when(k == 0, "RU").when(k == 1, "WORLD").alias("geo"))
    return facts.contradicted_subjects(_line_facts(spark, sf), docs)


@query("SELECT CAST(user_id AS VARCHAR) AS doc_id, value AS value_low, round(abs((value + value) / 2 - 45), 6) AS distance FROM events WHERE value <= 50 AND value >= 40 ORDER BY abs((value + value) / 2 - 45), CAST(user_id AS VARCHAR) LIMIT 20")
def numeric_range(spark, sf):
    return search.in_range(_facts(spark, sf), 40, 50).select("doc_id", "value_low", F.round("distance", 6).alias("distance"))


@query("""
SELECT dimension, value, n FROM (
SELECT 'category' AS dimension, lang AS value, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang UNION ALL SELECT 'geography', source, CAST(count(*) AS BIGINT) FROM documents GROUP BY source
UNION ALL SELECT 'year', CAST(1990 + doc_id % 30 AS VARCHAR), CAST(count(*) AS BIGINT) FROM documents GROUP BY 1990 + doc_id % 30 UNION ALL SELECT 'total', NULL, CAST(count(*) AS BIGINT) FROM documents)""")
def dash_counts(spark, sf):
    d = t(spark, sf, "documents")
    return facts.dashboard(d.select(F.col("lang").alias("category"), F.col("source").alias("geography"), (1990 + F.col("doc_id") % 30).cast("int").alias("year")))


@query("SELECT 'd' || (user_id % 5) AS key, CAST(count(DISTINCT user_id) AS BIGINT) AS docs, CAST(count(*) AS BIGINT) AS facts FROM events GROUP BY user_id % 5")
def coverage(spark, sf):
    return facts.coverage(_docs(spark, sf), _facts(spark, sf), F.explode("domains"))


@query("""
SELECT l_orderkey AS canon, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS docs, count(DISTINCT l_suppkey) = 1 AS low_sources, bool_and(l_suppkey % 2 = 0) AS only_ru, bool_and(l_suppkey % 2 = 1) AS only_world
FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 1 OR bool_and(l_suppkey % 2 = 0) OR bool_and(l_suppkey % 2 = 1)""")
def risk_zones(spark, sf):
    line = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("canon"), F.col("l_suppkey").alias("doc_id"))
    docs = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.when(F.col("s_suppkey") % 2 == 0, "RU").otherwise("WORLD").alias("geo"))
    return facts.risk_zones(line, docs)


@query("SELECT CAST(user_id AS VARCHAR) AS doc_id, CAST(count(*) AS BIGINT) AS facts, max(ts) AS last_extracted FROM events GROUP BY user_id ORDER BY max(ts) DESC, CAST(user_id AS VARCHAR) LIMIT 20")
def activity(spark, sf):
    return facts.activity(_facts(spark, sf))


@query("""
WITH a AS (SELECT user_id, count(*) AS facts, max(ts) AS last FROM events GROUP BY user_id ORDER BY 3 DESC, CAST(user_id AS VARCHAR) LIMIT 20)
SELECT CAST(user_id AS VARCHAR) AS doc_id, CAST(facts AS BIGINT) AS facts, last AS last_extracted, CAST((user_id % 2 = 0)::INT + (user_id % 3 = 0)::INT AS BIGINT) AS experts, CAST(2000 + user_id % 20 AS INTEGER) AS year, CASE user_id % 4 WHEN 0 THEN 'RU' WHEN 1 THEN 'WORLD' END AS geo FROM a""")
def activity_experts(spark, sf):
    u = t(spark, sf, "events").select("user_id").distinct()
    own = lambda k: u.where(F.col("user_id") % k == 0).select(F.lit(f"e{k}").alias("name"), F.array(F.col("user_id").cast("string")).alias("doc_ids"))
    docs = _docs(spark, sf).withColumn("year", (2000 + F.col("doc_id").cast("long") % 20).cast("int"))
    return facts.activity(_facts(spark, sf), 20, own(2).union(own(3)), docs)


@query(f"""
WITH c AS (SELECT 'Process:' || s AS a, 'Parameter:' || p AS b, (max(v) - min(v)) / max(v) AS spread FROM ({_VP}) GROUP BY s, p HAVING count(*) >= 2 AND (max(v) - min(v)) / max(v) > 0.3 ORDER BY 3 DESC, 1, 2 LIMIT 5),
p AS (SELECT 'Process:' || s_suppkey AS process FROM supplier ORDER BY 1 LIMIT 20), m AS (SELECT 'Material:' || p_partkey AS material FROM part ORDER BY 1 LIMIT 20),
g AS (SELECT process, material FROM p, m WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE 'Process:' || l_suppkey = process AND 'Material:' || l_partkey = material) ORDER BY 1, 2 LIMIT 5)
SELECT 'contradiction' AS kind, a, b, round(spread, 6) AS spread FROM c UNION ALL SELECT 'gap', process, material, NULL FROM g""")
def dashboard_top(spark, sf):
    return facts.top_problems(graph.contradictions(_evidence(spark, sf)[1]), gaps(spark, sf)).withColumn("spread", F.round("spread", 6))


@query("SELECT c_mktsegment AS name, CAST(count(DISTINCT c_custkey) AS INTEGER) AS documents, CAST(count(DISTINCT c_nationkey) AS INTEGER) AS domains, string_agg(DISTINCT CAST(c_nationkey AS VARCHAR), ',' ORDER BY CAST(c_nationkey AS VARCHAR)) AS domain_list FROM customer GROUP BY c_mktsegment ORDER BY 2 DESC, 1 LIMIT 20")
def expert_coverage(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_mktsegment").alias("name"), F.array(F.col("c_custkey").cast("string")).alias("doc_ids"), F.array(F.col("c_nationkey").cast("string")).alias("domains"))
    return facts.expert_coverage(c).withColumn("domain_list", F.array_join("domain_list", ","))


@query("""
SELECT l_linestatus AS process, min(l_quantity) FILTER (l_returnflag = 'A') AS "A_min", max(l_quantity) FILTER (l_returnflag = 'A') AS "A_max", CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS "A_samples",
min(l_quantity) FILTER (l_returnflag = 'Z') AS "Z_min", max(l_quantity) FILTER (l_returnflag = 'Z') AS "Z_max", CAST(nullif(count(*) FILTER (l_returnflag = 'Z'), 0) AS BIGINT) AS "Z_samples" FROM lineitem GROUP BY l_linestatus""")
def compare_pivot(spark, sf):
    line = t(spark, sf, "lineitem").select(F.col("l_linestatus").alias("process"), F.col("l_returnflag").alias("metric"), F.col("l_quantity").alias("value_low"), F.col("l_quantity").alias("value_high"))
    return facts.compared(line, ["A", "Z"])


@query("""
SELECT l_linestatus AS process, min(l_quantity) FILTER (l_returnflag = 'A') AS "A_min", max(l_quantity) FILTER (l_returnflag = 'A') AS "A_max", CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS "A_samples", CASE WHEN bool_or(l_returnflag = 'A') THEN 'mg_per_l' END AS "A_unit",
  CASE WHEN bool_or(l_returnflag = 'A') THEN 'мг/л' END AS "A_unit_label", min(l_quantity) FILTER (l_returnflag = 'N') AS "N_min", max(l_quantity) FILTER (l_returnflag = 'N') AS "N_max", CAST(nullif(count(*) FILTER (l_returnflag = 'N'), 0) AS BIGINT) AS "N_samples",
  CASE WHEN bool_or(l_returnflag = 'N') THEN 'bar' END AS "N_unit", CASE WHEN bool_or(l_returnflag = 'N') THEN 'bar' END AS "N_unit_label" FROM lineitem GROUP BY l_linestatus""")
def compare_units(spark, sf):
    unit = F.when(F.col("l_returnflag") == "A", "mg_per_l").otherwise("bar")
    line = t(spark, sf, "lineitem").select(F.col("l_linestatus").alias("process"), F.col("l_returnflag").alias("metric"), F.col("l_quantity").alias("value_low"), F.col("l_quantity").alias("value_high"), unit.alias("unit"))
    return facts.compared(line, ["A", "N"], units=True)


@query("SELECT axis FROM (VALUES ('A'), ('Q'), ('N'), ('Z')) v(axis) WHERE axis NOT IN (SELECT l_returnflag FROM lineitem)")
def compare_unavailable(spark, sf):
    return facts.unavailable(t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("metric")), ["A", "Q", "N", "Z"])


@query("""
WITH s AS (SELECT 'u1' AS u, 'c' AS q, TIMESTAMP '2024-01-15' AS s UNION ALL SELECT 'u2', 'view', TIMESTAMP '2024-01-20'),
n AS (SELECT u, q, event_type, row_number() OVER (PARTITION BY u, q ORDER BY ts DESC, CAST(user_id AS VARCHAR), event_type) AS k FROM s JOIN events ON contains(event_type, q) AND ts > s)
SELECT CAST(count(*) AS BIGINT) AS n, q AS query, u AS user, string_agg(event_type, ',' ORDER BY k) FILTER (k <= 3) AS sample FROM n GROUP BY q, u""")
def notify_check(spark, sf):
    subs = spark.sql("SELECT 'u1' AS user, 'c' AS query, TIMESTAMP '2024-01-15' AS last_seen UNION ALL SELECT 'u2', 'view', TIMESTAMP '2024-01-20'")
    return facts.notifications(subs, _facts(spark, sf)).withColumn("sample", F.array_join("sample", ","))


@query("SELECT event_id AS id, ts AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def audit_tail(spark, sf):
    return facts.audit_tail(t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("event"))).select("id", "at")


@query("SELECT CAST(user_id AS VARCHAR) AS query, max(ts) AS at FROM events GROUP BY user_id ORDER BY max(ts) DESC, CAST(user_id AS VARCHAR) LIMIT 8")
def history_mru(spark, sf):
    return facts.history(t(spark, sf, "events").select(F.col("user_id").cast("string").alias("query"), F.col("ts").alias("at")))


@query("SELECT CAST(user_id AS VARCHAR) AS doc_id, CAST(count(*) AS BIGINT) AS n, string_agg(event_type || ':' || value, ',' ORDER BY event_type, value) AS facts FROM events GROUP BY user_id")
def experiments(spark, sf):
    each = F.transform("facts", lambda f: F.concat_ws(":", f.canon, f.value_low.cast("string")))
    return facts.experiments(_facts(spark, sf)).select("doc_id", "n", F.array_join(each, ",").alias("facts"))


# --- time, exports, questions ---


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type AS key, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2, 3")
def window_tumbling(spark, sf):
    return incremental.tumbling(t(spark, sf, "events"))


@query("""
SELECT user_id AS key, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g
FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g""")
def window_session(spark, sf):
    return incremental.sessions(t(spark, sf, "events"))


@query("""
SELECT row_number() OVER (ORDER BY doc_id, event_type, line) AS n, row_number() OVER (ORDER BY doc_id, event_type, line) || '. ' || line AS text FROM (
SELECT CAST(user_id AS VARCHAR) AS doc_id, event_type, event_type || ' · value: ' || regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') || ' · ' AS line FROM events)""")
def export_markdown(spark, sf):
    return store.markdown_lines(_facts(spark, sf))


@query(f"""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'compare' WHEN 1 THEN 'gaps' ELSE 'search' END AS intent, CASE p_partkey % 5 WHEN 0 THEN 'Foreign,Global' WHEN 3 THEN 'Russia,CIS,Global' END AS geography,
  CASE p_partkey % 5 WHEN 0 THEN least(2000 + p_size % 30, 2020) WHEN 1 THEN 2024 - p_size END AS year_from, CASE p_partkey % 5 WHEN 0 THEN greatest(2000 + p_size % 30, 2020) WHEN 1 THEN 2024 END AS year_to,
  CASE p_partkey % 5 WHEN 2 THEN 'никель не более ' || p_size || '.5 мг/л' WHEN 3 THEN 'выход >= ' || p_size || '.0 ;т от 5.0 ' ELSE '' END AS conditions FROM part""")
def parse_query(spark, sf):
    k, n = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    asked = F.when(k == 0, F.concat(F.lit("Сравнить мировая практика 20"), F.lpad((F.col("p_size") % 30).cast("string"), 2, "0"), F.lit(" и 2020"))).when(k == 1, F.concat(F.lit("нет данных за последние "), n, F.lit(" лет")))
    asked = asked.when(k == 2, F.concat(F.lit("Никель не более "), n, F.lit(",5 мг/л"))).when(k == 3, F.concat(F.lit("в России: выход >= "), n, F.lit(" г/т от 5 до 7 г/л"))).otherwise(F.col("p_name"))
    got = answer.parsed(t(spark, sf, "part").select("p_partkey", asked.alias("query")), 2024)
    each = F.transform("conditions", lambda c: F.concat_ws(" ", c.parameter, c.operator, c.value.cast("string"), c.unit))
    return got.select("p_partkey", "intent", F.array_join("geography", ",").alias("geography"), "year_from", "year_to", F.array_join(each, ";").alias("conditions"))


@query(f"SELECT id, type, name FROM {_N} WHERE contains(lower(name), 'er#00') ORDER BY id LIMIT 10")
def autocomplete_nodes(spark, sf):
    return graph.autocomplete(_star(spark, sf)[0], "er#00").select("id", "type", "name")


@query("""
SELECT 'Process (Process) —has_parameter→ Parameter:' || p || ' [' || n || ']' AS line FROM (
SELECT l_partkey % 50 AS p, count(DISTINCT l_orderkey) AS n, row_number() OVER (ORDER BY 'Parameter:' || (l_partkey % 50)) AS k FROM lineitem WHERE l_suppkey = 3 GROUP BY l_partkey % 50) WHERE k <= 10""")
def graph_query_facts(spark, sf):
    edge = graph.edge_table(_evidence(spark, sf)[1])
    node = t(spark, sf, "supplier").select(F.concat(F.lit("Process:"), "s_suppkey").alias("id"), F.lit("Process").alias("type"), F.when(F.col("s_suppkey") == 3, "Process").otherwise("other").alias("canonical"))
    return graph.query_facts(node, edge, "which process is it?")


_FS = "(SELECT CAST(user_id AS VARCHAR) AS doc_id, event_type AS canon, CAST(contains(event_type, 'click') AS INTEGER) + CAST(contains(event_type, 'purchase') AS INTEGER) + 1 AS score FROM events)"


@query(f"SELECT doc_id, canon, score FROM {_FS} ORDER BY score DESC, doc_id, canon LIMIT 8")
def fact_keyword_search(spark, sf):
    return search.fact_search(_facts(spark, sf), "click or purchase value").select("doc_id", "canon", "score")


@query("SELECT event_id, CASE WHEN regexp_matches(event_type, '^c') THEN 'compare' WHEN regexp_matches(event_type, 'e$') THEN 'experts' ELSE 'search' END AS intent FROM events")
def intent_routing(spark, sf):
    return search.route(t(spark, sf, "events").select("event_id", F.col("event_type").alias("query")), [("^c", "compare"), ("e$", "experts")]).select("event_id", "intent")


@query(f"""
WITH a AS (SELECT doc_id, min(distance) AS distance FROM (SELECT CAST(user_id AS VARCHAR) AS doc_id, abs(value - 45) AS distance FROM events WHERE value <= 50 AND value >= 40 ORDER BY 2, 1 LIMIT 50) GROUP BY doc_id),
b AS (SELECT doc_id, max(score) AS score FROM (SELECT * FROM {_FS} ORDER BY score DESC, doc_id, canon LIMIT 40) GROUP BY doc_id)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, round(distance, 6) AS distance, score, distance IS NOT NULL AS in_range FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id""")
def merged_tracks(spark, sf):
    f = _facts(spark, sf)
    return search.merged_tracks(search.in_range(f, 40, 50, 50), search.fact_search(f, "click or purchase value", 40)).select("doc_id", F.round("distance", 6).alias("distance"), "score", "in_range")


@query(_BM25 + "SELECT id AS doc_id, score FROM hit ORDER BY score DESC, id LIMIT 10")
def bm25_stored_index(spark, sf):
    path, texts = store.shared_path(spark, "index"), t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    store.save(path, postings=search.postings(texts), corpus_stats=search.corpus_stats(texts))
    kept = store.load(spark, path, "postings", "corpus_stats")
    corpus = kept["corpus_stats"].first()
    store.save(path, term_stats=search.term_stats(kept["postings"], corpus.n))
    top = search.bm25_indexed(kept["postings"], store.load(spark, path, "term_stats")["term_stats"], corpus.avg_len, "the and there", 50).collect()
    store.remove(spark, path)
    found = spark.createDataFrame([tuple(r) for r in top], "id long, score double")  # 50 rows at most
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query(
    _BM25
    + f""", f AS (SELECT id, sum(ln((n - d + 0.5) / (d + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / a))) AS score FROM tf JOIN df USING (term), s WHERE tf > 0 GROUP BY id),
b AS (SELECT id, score FROM f ORDER BY score DESC, id LIMIT 30), v AS (SELECT e.vec_id AS id, {_DOT} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, id LIMIT 30),
c AS (SELECT coalesce(b.id, v.id) AS id, 0.4 * coalesce(b.score / (SELECT max(score) FROM b), 0) + 0.6 * coalesce(v.score / (SELECT max(score) FROM v), 0) AS score FROM b FULL OUTER JOIN v ON b.id = v.id ORDER BY 2 DESC, 1 LIMIT 30)
SELECT c.id AS chunk_id, doc_id, substr(text, 1, 500) AS text, round(score, 4) AS score, lang AS language, source AS source_type FROM c JOIN documents ON c.id = doc_id
WHERE lang = 'en' AND source IN (SELECT 'src' || i FROM range(15) r(i)) AND doc_id % 4 < 3 AND (doc_id % 3 = 0 OR 1990 + doc_id % 30 >= 1995) ORDER BY round(score, 4) DESC, c.id LIMIT 15"""
)
def hybrid_search(spark, sf):
    d, e, k = t(spark, sf, "documents"), t(spark, sf, "embeddings"), F.col("doc_id")
    meta = d.select(k.alias("id"), F.col("lang").alias("language"), F.col("source").alias("source_type"), F.when(k % 3 != 0, (1990 + k % 30).cast("int")).alias("year"), F.concat(F.lit("g"), (k % 4).cast("string")).alias("geography"))
    want = {"language": "en", "geography": ["g0", "g1", "g2"], "source_type": [f"src{i}" for i in range(15)], "year_from": 1995}
    vectors = e.select(F.col("vec_id").alias("id"), "embedding")
    got = search.search(d.select(k.alias("id"), "doc_id", "text"), meta, "the and there", 15, vectors, e.where("vec_id = 0").first().embedding, filters=want)
    return got.select("chunk_id", "doc_id", "text", "score", "language", "source_type")


@query(_BM25 + """, f AS (SELECT id, sum(ln((n - d + 0.5) / (d + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / a))) AS score FROM tf JOIN df USING (term), s WHERE tf > 0 GROUP BY id),
b AS (SELECT id, score FROM f ORDER BY score DESC, id LIMIT 16)
SELECT id AS doc_id, round(0.4 * score / (SELECT max(score) FROM b), 4) AS score, 'search' AS intent, 8 AS n_sources, 8 AS told FROM b ORDER BY round(0.4 * score / (SELECT max(score) FROM b), 4) DESC, id LIMIT 8""")
def answered_question(spark, sf):
    d, ev = t(spark, sf, "documents"), _evidence(spark, sf)[1]
    node, edge = _star(spark, sf)
    edge = edge.withColumns({"n_sources": F.lit(2), "value_low": F.lit(None).cast("double")})
    got = answer.answer("the and there", d.select(F.col("doc_id").alias("id"), "doc_id", "text"), d.select(F.col("doc_id").alias("id")), node.withColumn("n_sources", F.lit(2)), edge, ev)
    told = int(got["answer"].rsplit(" ", 1)[1])
    rows = [(s["doc_id"], s["score"], got["intent"], len(got["sources"]), told) for s in got["sources"]]
    return spark.createDataFrame(rows, "doc_id long, score double, intent string, n_sources int, told int")


@query("""
SELECT 'years' AS kind, CAST(2000 + user_id % 20 AS VARCHAR) AS value FROM events WHERE user_id % 3 > 0 GROUP BY ALL UNION ALL SELECT 'materials', event_type FROM events GROUP BY ALL
UNION ALL SELECT 'geos', CASE user_id % 4 WHEN 0 THEN 'RU' ELSE 'WORLD' END FROM events WHERE user_id % 4 < 2 GROUP BY ALL UNION ALL SELECT 'processes', 'p' || (user_id % 7) FROM events GROUP BY ALL""")
def filter_options(spark, sf):
    f = _facts(spark, sf).withColumn("process", F.concat(F.lit("p"), (F.col("doc_id").cast("long") % 7).cast("string")))
    out = None
    for kind, values in facts.filter_options(f, _docs(spark, sf)).items():
        one = values.select(F.lit(kind).alias("kind"), F.col(values.columns[0]).cast("string").alias("value"))
        out = one if out is None else out.union(one)
    return out


@query("""
SELECT user_id AS "user", event_type AS query, max(ts) FILTER (event_id % 3 < 2) AS last_seen FROM events GROUP BY user_id, event_type HAVING arg_max(event_id % 3, ts) FILTER (event_id % 3 <> 1) = 0""")
def subscriptions(spark, sf):
    k = F.col("event_id") % 3
    action = F.when(k == 0, "subscribe").when(k == 1, "seen").otherwise("unsubscribe")
    return facts.subscriptions(t(spark, sf, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("query"), action.alias("action"), F.col("ts").alias("at")))


@query(f"""
WITH u AS (SELECT DISTINCT user_id, has FROM events, (VALUES (true), (false)) h(has)), c AS (SELECT 1 FROM ({_VP}) GROUP BY s, p HAVING count(*) >= 2 AND (max(v) - min(v)) / max(v) > 0.3)
SELECT CAST(count(*) AS BIGINT) AS docs, CAST(count(*) FILTER (user_id % 4 = 0) AS BIGINT) AS ru, CAST(count(*) FILTER (user_id % 4 = 1) AS BIGINT) AS world, CAST(count(*) FILTER (user_id % 4 > 1) AS BIGINT) AS geo_unknown,
  CAST(count(*) FILTER (has) AS BIGINT) AS docs_with_facts, (SELECT CAST(count(*) AS BIGINT) FROM events) AS facts, (SELECT CAST(count(*) AS BIGINT) FROM supplier) AS experts,
  (SELECT CAST(count(*) AS BIGINT) FROM c) AS contradictions, CAST(count(DISTINCT user_id % 5) AS BIGINT) AS domains, round(count(*) FILTER (user_id % 4 = 0) / count(*), 4) AS ru_share, round(count(*) FILTER (user_id % 4 = 1) / count(*), 4) AS world_share,
  round(count(*) FILTER (has) / count(*), 4) AS fact_coverage FROM u""")
def summary_kpi(spark, sf):
    # documents are users and twice as many that no event names
    docs = _docs(spark, sf)
    docs = docs.unionByName(docs.withColumn("doc_id", F.concat(F.lit("-"), "doc_id")))
    row = facts.summary(docs, _facts(spark, sf), t(spark, sf, "supplier"), graph.contradictions(_evidence(spark, sf)[1]))
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'long'}" for k, v in row.items()))


@query("""
SELECT CASE WHEN user_id % 3 > 0 THEN CAST(2000 + user_id % 20 AS INTEGER) END AS year, CASE user_id % 4 WHEN 0 THEN 'RU' WHEN 1 THEN 'WORLD' END AS geo, CAST(count(*) AS BIGINT) AS facts, CAST(count(DISTINCT user_id) AS INTEGER) AS n_sources,
  coalesce(max(value) - min(value) <= 0.1 * abs(max(value)), true) AS consensus FROM events GROUP BY 1, 2""")
def literature_review(spark, sf):
    return answer.review(_facts(spark, sf).drop("geo"), _docs(spark, sf)).select("year", "geo", "facts", F.size("sources").alias("n_sources"), "consensus")


@query("""
SELECT event_type AS method, CASE WHEN user_id % 3 > 0 THEN CAST(2000 + user_id % 20 AS INTEGER) END AS year, CASE user_id % 4 WHEN 0 THEN 'RU' WHEN 1 THEN 'WORLD' END AS geo, CAST(count(*) AS BIGINT) AS facts,
  string_agg(DISTINCT CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)) AS sources, coalesce(max(value) - min(value) <= 0.1 * abs(max(value)), true) AS consensus FROM events GROUP BY 1, 2, 3""")
def literature_review_methods(spark, sf):
    got = answer.review(_facts(spark, sf).drop("geo").withColumnRenamed("canon", "method"), _docs(spark, sf), ("method", "year", "geo"))
    return got.withColumn("sources", F.array_join("sources", ","))


@query("""
SELECT 'adjacent' AS kind, event_type AS value FROM (SELECT DISTINCT event_type FROM events WHERE user_id % 2 = 1 AND event_type <> 'click' ORDER BY 1 LIMIT 4) UNION ALL SELECT 'expert', 'e' || (user_id % 6) FROM events WHERE user_id % 2 = 1 GROUP BY ALL
UNION ALL SELECT 'hidden', CAST(count(*) FILTER (user_id % 2 = 0) AS VARCHAR) FROM events UNION ALL SELECT 'facts', CAST(count(*) FILTER (user_id % 2 = 1) AS VARCHAR) FROM events""")
def assembled_answer(spark, sf):
    u = t(spark, sf, "events").select("user_id").distinct()
    experts = u.select(F.concat(F.lit("e"), (F.col("user_id") % 6).cast("string")).alias("name"), F.array(F.col("user_id").cast("string")).alias("doc_ids"))
    got = answer.assemble(_facts(spark, sf), experts, "external_partner", ["click"])
    one = lambda kind, df: df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).cast("string").alias("value"))
    return one("adjacent", got["adjacent"]).union(one("expert", got["experts"])).union(one("hidden", got["hidden"])).union(one("facts", got["facts"].agg(F.count(F.lit(1)))))


@query("""
SELECT p_partkey, CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '–' || (p_size + 1) END || CASE p_partkey % 3 WHEN 0 THEN ' %' WHEN 1 THEN ' мг/л' ELSE ' bar' END AS value,
  CASE WHEN v >= 1e6 THEN regexp_replace(CAST(round(v / 1e6, 1) AS VARCHAR), '\\.0$', '') || ' млн' WHEN v >= 1e3 THEN regexp_replace(CAST(round(v / 1e3, 1) AS VARCHAR), '\\.0$', '') || ' тыс.'
    ELSE regexp_replace(CAST(v AS VARCHAR), '\\.0$', '') END AS compact
FROM (SELECT *, CAST(p_partkey * 1000 + 120 * (p_partkey % 7) + 20 AS DOUBLE) AS v FROM part)""")
def display_labels(spark, sf):
    k = F.col("p_partkey")
    unit = F.when(k % 3 == 0, "percent").when(k % 3 == 1, "mg_per_l").otherwise("bar")
    return t(spark, sf, "part").select("p_partkey", T.value_label(F.col("p_size"), F.col("p_size") + k % 2, unit).alias("value"), T.compact_number(k * 1000 + 120 * (k % 7) + 20).alias("compact"))


@query("""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'review' ELSE 'report' END AS category, CASE doc_id % 3 WHEN 0 THEN 'scientific_article' WHEN 1 THEN 'review' ELSE 'internal_report' END AS source_type,
  CASE doc_id % 3 WHEN 0 THEN 5 ELSE 4 END AS trust, printf('%d_%04d', doc_id, doc_id % 12000) AS chunk_id FROM documents""")
def path_metadata(spark, sf):
    k = F.col("doc_id")
    path = F.when(k % 3 == 0, "x/y.PDF").when(k % 3 == 1, "x/Обзоры/Статьи/y.pdf").otherwise("x/y.docx")
    d = t(spark, sf, "documents").select("doc_id", T.category(path).alias("c"), T.chunk_id(k.cast("string"), k % 12000).alias("chunk_id"))
    return d.select("doc_id", "c.category", "c.source_type", T.trust(F.col("c.source_type")).alias("trust"), "chunk_id")


@query("""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(\\p{L})-\\n(\\p{L})', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g'), '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')) AS md5 FROM documents""")
def ocr_cleanup(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.md5(T.ocr_normalised("text").cast("binary")).alias("md5"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'никель и медь ' || p_name WHEN 1 THEN 'ОРЕХ ' || p_name ELSE 'coal ' || p_name END AS text, CASE p_partkey % 3 WHEN 0 THEN 'Иванов И.И.|Smith A.' WHEN 1 THEN 'Петров П' ELSE '' END AS authors FROM part""")
def lookalikes_and_names(spark, sf):
    k = F.col("p_partkey") % 3
    scanned = F.when(k == 0, "ни-\nкeль  и\tмeдь ").when(k == 1, "OРEХ ").otherwise("coal ")
    signed = F.when(k == 0, "Иванов И.И., Smith A.\nOther O").when(k == 1, "no name\nПетров П\n").otherwise("none here\n")
    return t(spark, sf, "part").select("p_partkey", T.ocr_normalised(F.concat(scanned, F.col("p_name"))).alias("text"), F.array_join(T.authors(signed), "|").alias("authors"))


@query("SELECT c_custkey, '2024-01-31-' || regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') || '.md' AS name FROM customer")
def export_names(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", T.file_slug("c_name", F.lit("2024-01-31"), "md").alias("name"))


@query("""
SELECT b AS start, b + INTERVAL 1 HOUR AS "end", event_type AS key, CAST(count(*) AS BIGINT) AS n
FROM (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) - s.m AS b FROM events, (VALUES (INTERVAL 0 MINUTE), (INTERVAL 30 MINUTE)) s(m)) GROUP BY 1, 2, 3""")
def window_sliding(spark, sf):
    return incremental.tumbling(t(spark, sf, "events"), slide="30 minutes")


@query("""
SELECT '{"@type":"Claim","about":"' || event_type || '","name":"value","value":[' || value || ',' || value || '],"unitText":"x","citation":"' || user_id || '"}' AS text FROM events""")
def export_jsonld(spark, sf):
    return store.json_ld_claims(_facts(spark, sf))


@query("""
SELECT event_type AS material, value AS value_low, CAST(user_id AS VARCHAR) AS doc_id, CASE WHEN user_id % 3 > 0 THEN CAST(2000 + user_id % 20 AS INTEGER) END AS year FROM events
WHERE regexp_matches(event_type, 'click|view') AND value <= 50 AND (user_id % 3 = 0 OR 2000 + user_id % 20 >= 2010)""")
def reference_rows(spark, sf):
    return facts.reference_rows(_facts(spark, sf), ["Click", "view"], ["x"], 50, 2010).select("material", "value_low", "doc_id", "year")


@query(_CHUNKS + "SELECT doc_id, idx, text FROM r")
def chunk_table(spark, sf):
    chunking.register(spark)
    return spark.sql("SELECT d.doc_id, c.idx, c.text FROM {d} AS d, LATERAL kg_chunk(d.text, 1200, 200) AS c", d=t(spark, sf, "documents"))


# --- ready-made reports, over parts that bear the reports' subjects ---

_NAMED = "(SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Сульфаты' WHEN 1 THEN 'золото' WHEN 2 THEN 'никель' WHEN 3 THEN 'Platinum ore' ELSE p_name END AS canon, CASE WHEN p_partkey % 5 = 2 THEN 'католит' END AS phase, CAST(p_size AS DOUBLE) * 10 AS v, CASE WHEN p_partkey % 2 = 0 THEN 'мг/л' ELSE 'g_t' END AS unit, CASE WHEN p_partkey % 7 > 0 THEN CAST(2010 + p_partkey % 15 AS INTEGER) END AS year FROM part)"


def _named(spark, sf):
    k = F.col("p_partkey")
    canon = F.when(k % 5 == 0, "Сульфаты").when(k % 5 == 1, "золото").when(k % 5 == 2, "никель").when(k % 5 == 3, "Platinum ore").otherwise(F.col("p_name"))
    v = F.col("p_size").cast("double") * 10
    return t(spark, sf, "part").select(canon.alias("canon"), F.when(k % 5 == 2, "католит").alias("phase"), F.lit("m").alias("metric"), v.alias("value_low"), v.alias("value_high"), F.when(k % 2 == 0, "мг/л").otherwise("g_t").alias("unit"), F.lit("q").alias("quote"), k.cast("string").alias("doc_id"), F.when(k % 7 > 0, (2010 + k % 15).cast("int")).alias("year"))


_REPORT = f"SELECT canon AS material, phase, 'm' AS metric, v AS value_low, v AS value_high, unit, 'q' AS quote, CAST(p_partkey AS VARCHAR) AS doc_id, year FROM {_NAMED} WHERE "


@query(_REPORT + "canon = 'Сульфаты' AND unit = 'мг/л' AND v <= 300")
def report_desalination(spark, sf):
    return facts.desalination(_named(spark, sf))


@query(_REPORT + "phase = 'католит'")
def report_catholyte(spark, sf):
    return facts.catholyte(_named(spark, sf))


@query(_REPORT + "(canon IN ('золото', 'Platinum ore') OR regexp_matches(lower(canon), 'gold|silver|platin|palladium|pgm')) AND (year IS NULL OR year >= 2019)")
def report_precious_metals(spark, sf):
    return facts.precious_metals(_named(spark, sf), 2024)


# --- functions in SQL, running heads ---


@query("""
SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\\x{0400}-\\x{04ff}]', '', 'g')) > 0.5 * length(regexp_replace(text, '[^A-Za-z]', '', 'g')) THEN 'ru' ELSE 'en' END AS language, CAST(nullif(regexp_extract(substr(text, 1, 3000), '(20[0-2][0-9]|19[89][0-9])', 1), '') AS INTEGER) AS year,
  CAST(len(list_filter(regexp_extract_all(lower(text), '[а-яёa-z0-9]+'), lambda x: length(x) > 1)) AS INTEGER) AS n_tokens, repeat('★', CAST(doc_id % 6 AS INTEGER)) || repeat('☆', 5 - CAST(doc_id % 6 AS INTEGER)) AS stars, CASE WHEN doc_id % 2 = 0 THEN 'медь' ELSE lang END AS term FROM documents""")
def sql_functions(spark, sf):
    T.register(spark)
    return spark.sql(
        "SELECT doc_id, kg_detect_language(text) AS language, kg_extract_year(text) AS year, size(kg_tokenize(text)) AS n_tokens, kg_trust_stars(cast(doc_id % 6 AS INT)) AS stars, kg_normalize_term(CASE WHEN doc_id % 2 = 0 THEN ' \t Copper\n' ELSE lang END) AS term FROM {d}",
        d=t(spark, sf, "documents"),
    )


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'page one|page 2|page 3' ELSE 'head|page one|other|page 2|head|page 3' END AS pages FROM documents")
def running_heads(spark, sf):
    even = F.col("doc_id") % 2 == 0
    pages = F.when(even, F.array(F.lit("head\npage one\nfoot"), F.lit(" head \npage 2\nfoot"), F.lit("\nhead\npage 3\nfoot"))).otherwise(F.array(F.lit("head\npage one"), F.lit("other\npage 2"), F.lit("head\npage 3")))
    joined = F.array_join(F.filter(F.split(F.array_join(T.without_running_heads(pages), "\n"), "\n"), lambda x: x != ""), "|")
    return t(spark, sf, "documents").select("doc_id", joined.alias("pages"))


# --- streams, run until they have read what is there ---


def _stream(spark, sf, change):
    """The rows that a stream over the events has written, each once."""
    where = store.shared_path(spark, "stream")
    events = t(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    incremental.each_batch(change(stream) if change else stream, lambda b: b, f"{where}/rows", f"{where}/state").awaitTermination()
    return spark.read.parquet(f"{where}/rows")


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, 1 AS n FROM events GROUP BY user_id")
def stream_once_each(spark, sf):
    got = _stream(spark, sf, lambda s: incremental.once_each(s.withColumn("ts", F.to_timestamp(F.lit("2024-01-01"))), "user_id"))
    return got.groupBy(F.col("user_id").cast("string").alias("user_id")).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("SELECT event_id, 'u' || (n % 2) AS \"user\" FROM events JOIN (SELECT DISTINCT event_type AS e, length(event_type) AS n FROM events) ON event_type = e WHERE n > 4")
def stream_matches(spark, sf):
    kinds = t(spark, sf, "events").select(F.col("event_type").alias("canon")).distinct().where(F.length("canon") > 4)
    subscribed = kinds.select("canon", F.concat(F.lit("u"), (F.length("canon") % 2).cast("string")).alias("user"))
    return _stream(spark, sf, lambda s: incremental.matched(s.withColumnRenamed("event_type", "canon"), subscribed)).select("event_id", "user")


@query("SELECT event_type AS canonical, count(DISTINCT user_id) AS n_sources FROM events GROUP BY event_type")
def stream_graph_build(spark, sf):
    evidence = lambda s: s.select(F.lit("Material").alias("type"), F.col("event_type").alias("canonical"), F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("doc_id"), F.lit(1).alias("trust"), F.lit("x").alias("geography"), F.create_map(F.lit("k"), F.lit("v")).alias("properties"), F.col("event_id").alias("seq"))
    return graph.node_table(_stream(spark, sf, evidence)).select("canonical", "n_sources")
