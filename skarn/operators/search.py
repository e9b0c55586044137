"""Full-text, vector and combined search as plans over posting and vector tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from skarn.functions.text import tokens

K1, B = 1.5, 0.75


def counted(words: Column) -> Column:
    """array<struct<term,tf>> of a row's words: sorted, then each run's length."""

    def runs(s: Column) -> Column:
        edge = F.filter(F.transform(s, lambda x, i: F.struct(x.alias("term"), i.alias("at"))), lambda e: (e.at == 0) | (F.get(s, e.at - 1) != e.term))
        length = lambda e, i, all_: (F.coalesce(F.get(all_, i + 1).at, F.size(s)) - e.at).alias("tf")
        return F.transform(F.array(edge), lambda r: F.transform(r, lambda e, i: F.struct(e.term.alias("term"), length(e, i, r))))[0]

    return F.transform(F.array(F.sort_array(words)), lambda s: runs(s))[0]


def postings(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(term, id, tf, dl): counted inside each row, so nothing is shuffled."""
    t = texts.select(F.col(id_col).alias("id"), tokens(text_col).alias("t"))
    return t.select("id", F.size("t").alias("dl"), F.inline(counted(F.col("t")))).select("term", "id", "tf", "dl")


def corpus_stats(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(n, avg_len): one row; texts without tokens count as documents of length 0."""
    return texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size(tokens(text_col))), F.lit(0.0)).alias("avg_len"))


def query_terms(query: str) -> dict[str, int]:
    return dict(Counter(w for w in re.findall(r"[а-яёa-z0-9]+", query.lower()) if len(w) > 1))


def _times(t: Column, word: str) -> Column:
    return F.size(F.filter(t, lambda x: x == word))


def bm25(texts: DataFrame, query: str, k: int = 10, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, score) of the best k texts; ties by id. Terms of the query count as often as they stand in it.

    Two passes over the texts, one for the statistics: each row gives its length and its counts of the
    query's terms, so nothing but sums is shuffled. (Keeping these rows cached between the passes took
    longer.) For many queries a stored index is read instead: bm25_indexed().
    """
    want = query_terms(query)
    spark = texts.sparkSession
    if not want:
        return spark.createDataFrame([], f"id {dict(texts.dtypes)[id_col]}, score double")
    words = list(want)
    hit = F.transform(F.array(tokens(text_col)), lambda t: F.struct(F.size(t).alias("dl"), *[_times(t, w).alias(f"t{i}") for i, w in enumerate(words)]))[0]
    rows = texts.select(F.col(id_col).alias("id"), hit.alias("h")).select("id", "h.*")
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg"), *[F.coalesce(F.sum((F.col(f"t{i}") > 0).cast("long")), F.lit(0)).alias(f"d{i}") for i in range(len(words))]).first()
    avg = max(s["avg"] or 0.0, 1.0)
    score = F.lit(0.0)
    for i, w in enumerate(words):
        idf = math.log((s["n"] - s[f"d{i}"] + 0.5) / (s[f"d{i}"] + 0.5) + 1)
        tf = F.col(f"t{i}")
        score = score + want[w] * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / avg))
    return rows.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def term_stats(posted: DataFrame, n: int) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))


def bm25_indexed(posted: DataFrame, stats: DataFrame, avg_len: float, query: str, k: int = 10) -> DataFrame:
    """The same over a stored index: only the query's terms are read (a pushed filter on term)."""
    want = query_terms(query)
    if not want:
        return posted.sparkSession.createDataFrame([], f"id {dict(posted.dtypes)['id']}, score double")
    times = F.create_map(*[F.lit(x) for kv in want.items() for x in kv])
    some = posted.where(F.col("term").isin(list(want))).join(F.broadcast(stats.where(F.col("term").isin(list(want)))), "term")
    part = times[F.col("term")] * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / max(avg_len, 1.0)))
    return some.groupBy("id").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def hashed_encoder(size: int = 312) -> Callable[[list[str]], np.ndarray]:
    """A deterministic encoder that needs no model: signed hashed words and letter triples, unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for row, text in zip(out, texts):
            for w in re.findall(r"\w+", (text or "").lower()):
                for part in (w, *(f"#{w}#"[k : k + 3] for k in range(len(w)))):
                    h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
                    row[h % size] += 1.0 if h >> 63 else -1.0
            norm = float(np.linalg.norm(row))
            if norm:
                row /= norm
        return out

    return encode


def encode(text: Column, encoder: Callable[[list[str]], np.ndarray] | None = None) -> Column:
    """array<float> of a text by a plug-in encoder."""
    encoder = encoder or hashed_encoder()

    @pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(encoder(s.fillna("").tolist())), index=s.index)

    return run(text)


def add_vectors(vectors: DataFrame, texts: DataFrame, encoder: Callable[[list[str]], np.ndarray] | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """vectors (id, embedding) and those of texts whose ids they lack."""
    new = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(vectors.select("id"), "id", "left_anti")
    return vectors.select("id", "embedding").unionByName(new.select("id", encode(F.col("text"), encoder).alias("embedding")))


def within(seconds: float | None, call: Callable[[], object], otherwise: object = None) -> object:
    """What call() returns, or ``otherwise`` if it fails or takes longer; None waits for ever.

    A call that is late is left to end by itself; its result is dropped.
    """
    if seconds is None:
        return call()
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(call).result(timeout=seconds)
    except Exception:  # late, or failed in any way
        return otherwise
    finally:
        pool.shutdown(wait=False)


def vector_topk(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, score): exact dot products, best k; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vec_col, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    return vectors.select(F.col(id_col).alias("id"), dot.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def combined(text_hits: DataFrame, vector_hits: DataFrame | None, w_text: float | None = None, w_vector: float | None = None) -> DataFrame:
    """(id, score): both sides divided by their own maximum and weighed; a missing side counts 0. None takes 0.4 and 0.6."""
    w_text, w_vector = 0.4 if w_text is None else w_text, 0.6 if w_vector is None else w_vector
    if vector_hits is None:
        vector_hits = text_hits.limit(0)
    top = lambda df: df.agg(F.greatest(F.max("score"), F.lit(1e-9)).alias("m")).first()["m"] or 1.0  # noqa: E731  both are short lists
    a, b = text_hits.select("id", (F.col("score") / top(text_hits)).alias("a")), vector_hits.select("id", (F.col("score") / top(vector_hits)).alias("b"))
    return a.join(b, "id", "full_outer").select("id", (w_text * F.coalesce("a", F.lit(0.0)) + w_vector * F.coalesce("b", F.lit(0.0))).alias("score"))


def matches(filters: dict | None) -> Column:
    """Condition of search filters: lists of geography, category and source_type; language; years, where a missing year passes. Unknown keys are ignored."""
    out = F.lit(True)
    for key, want in (filters or {}).items():
        if want in (None, [], ""):
            continue
        if key in ("geography", "category", "source_type"):
            out = out & F.col(key).isin([want] if isinstance(want, str) else list(want))
        elif key == "language":
            out = out & (F.col("language") == want)
        elif key in ("year_from", "year_to"):
            year = F.col("year")
            out = out & (year.isNull() | (year == 0) | (year >= want if key == "year_from" else year <= want))
    return out


def search(
    chunks: DataFrame, docs: DataFrame, query: str, k: int = 15, vectors: DataFrame | None = None, query_vector: list[float] | None = None,
    w_text: float | None = None, w_vector: float | None = None, filters: dict | None = None, prefilter: bool = False, seconds: float | None = 10.0,
) -> DataFrame:
    """The best k chunks with their documents. Filters act on the 2k best, so fewer may return; prefilter=True filters first.

    The vector side, a list of 2k hits, is fetched within ``seconds``; if it fails or is late, text search
    answers alone.
    """
    if prefilter:
        chunks = chunks.join(docs.where(matches(filters)).select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
        vectors = vectors.join(chunks.select("id"), "id", "left_semi") if vectors is not None else None
    side = None
    if vectors is not None and query_vector is not None:
        hits = within(seconds, lambda: vector_topk(vectors, query_vector, 2 * k).collect())
        side = chunks.sparkSession.createDataFrame([tuple(r) for r in hits], f"id {dict(vectors.dtypes)['id']}, score double") if hits is not None else None
    best = combined(bm25(chunks, query, 2 * k), side, w_text, w_vector).orderBy(F.desc("score"), "id").limit(2 * k)
    hits = chunks.join(F.broadcast(best), "id").join(docs.withColumnRenamed("id", "doc_id"), "doc_id").where(matches(filters))
    keep = [c for c in ("doc_id", "filename", "title", "year", "geography", "category", "source_type", "language", "trust", "page") if c in hits.columns]
    return hits.select(F.col("id").alias("chunk_id"), F.substring("text", 1, 500).alias("text"), F.round("score", 4).alias("score"), *keep).orderBy(F.desc("score"), "chunk_id").limit(k)


def listed(docs: DataFrame, category: str | None = None, geography: str | None = None, year_from: int | None = None, year_to: int | None = None, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(rows, count before the limit) of documents; here a missing year fails a bound on years. Newest first."""
    out = docs
    for name, want in (("category", category), ("geography", geography)):
        out = out.where(F.col(name) == want) if want else out
    out = out.where(F.col("year") >= year_from) if year_from else out
    out = out.where(F.col("year") <= year_to) if year_to else out
    return out.orderBy(F.coalesce("year", F.lit(0)).desc(), "id").limit(limit), out.agg(F.count(F.lit(1)).alias("count"))


def fact_search(facts: DataFrame, query: str, k: int = 8) -> DataFrame:
    """Facts by how many words of the query, longer than three letters, stand in them."""
    words = F.array(*[F.lit(w) for w in sorted(set(re.findall(r"\w+", query.lower()))) if len(w) > 3]).cast("array<string>")
    low = F.lower(F.concat_ws(" ", "canon", "metric", "quote"))
    score = F.size(F.filter(words, lambda w: F.contains(low, w)))
    return facts.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "doc_id", "canon").limit(k)


def route(queries: DataFrame, rules: list[tuple[str, str]], default: str = "search") -> DataFrame:
    """queries (query) with the intent of the first rule (pattern, intent) that matches."""
    case = F.lit(default)
    for pattern, intent in reversed(rules):
        case = F.when(F.rlike(F.lower("query"), F.lit(pattern)), intent).otherwise(case)
    return queries.withColumn("intent", case)


def in_range(facts: DataFrame, low: float, high: float, k: int = 20) -> DataFrame:
    """Facts whose range meets [low, high], the nearest middle first."""
    mid = (F.col("value_low") + F.col("value_high")) / 2
    return facts.where((F.col("value_low") <= high) & (F.col("value_high") >= low)).withColumn("distance", F.abs(mid - (low + high) / 2)).orderBy("distance", "doc_id").limit(k)


def merged_tracks(numeric: DataFrame, semantic: DataFrame) -> DataFrame:
    """One row a document of both tracks: numeric hits first, then by distance and score."""
    a = numeric.groupBy("doc_id").agg(F.min("distance").alias("distance"))
    b = semantic.groupBy("doc_id").agg(F.max("score").alias("score"))
    return a.join(b, "doc_id", "full_outer").withColumn("in_range", F.col("distance").isNotNull()).orderBy(F.desc("in_range"), "distance", F.desc("score"), "doc_id")
