"""Quality rules in DataFrame functions only: base counts of each text, then a hashed n-gram ratio.

The n-grams are the lower-case words, and word shapes and pairs of neighbouring shapes, to which rare words
and pairs of words back off (a shape folds runs of lower-case letters, upper-case letters, digits and signs,
so it holds for every language). They are hashed to ``buckets`` counters. The verdict on a text is the mean
over its n-grams of log(p_target / p_raw): p_target from the trusted texts, p_raw from all, both add-one
smoothed multinomials. A text is kept if its base rules hold and the mean reaches the threshold; equal texts
always get equal verdicts.

Defined results: null and empty texts have no words, fail the base rules and are not kept; without
trusted texts all ratios are 0; a mean that equals the threshold is kept; texts of any length are counted
whole; repeated rows each get a row and count each; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import let, materialise

SPACE = r"[\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    """Words: runs without ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def window_hashes(words: Column, width: int = 5) -> Column:
    """A 64-bit hash of each window of so many words."""

    def of(h: Column) -> Column:
        n = F.size(h)
        return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def covered(hashes: Column, width: int = 5) -> Column:
    """Words in windows whose hash occurs twice or more. Only texts with such a window are sorted."""

    def places(s: Column) -> Column:
        at = F.transform(
            F.filter(F.transform(s, lambda x, i: F.struct(x.p.alias("p"), ((F.get(s, i - 1).h == x.h) | F.coalesce(F.get(s, i + 1).h == x.h, F.lit(False))).alias("d"))), lambda x: F.coalesce(x.d, F.lit(False))),
            lambda x: x.p,
        )
        return let(
            F.sort_array(at),
            lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))), F.lit(0).cast("long"), lambda a, x: a + x),
        )

    twice = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(twice, let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), places)).otherwise(F.lit(0).cast("long"))


def shapes(joined: Column) -> Column:
    """Words joined by spaces as shapes: lower-case runs a, upper-case runs A, digit runs 0, runs of one sign the sign twice."""
    letters = F.regexp_replace(F.regexp_replace(joined, r"[\p{Ll}\p{Lo}\p{M}]+", "a"), r"\p{Lu}+", "A")
    return F.regexp_replace(F.regexp_replace(letters, r"\p{Nd}+", "0"), r"([^aA0 ])\1+", "$1$1")


def grams(words: Column, buckets: int) -> Column:
    """Bucket numbers g of the words, shapes and shape pairs with their counts c, each packed into one number c * buckets + g.

    (A list of structs takes 32 bytes an entry in a shuffle, a list of numbers 8.)
    """

    def runs(g: Column) -> Column:
        starts = F.filter(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"), ((i == 0) | (F.get(g, i - 1) != x)).alias("new"))), lambda x: x.new)
        return let(starts, lambda s: F.transform(s, lambda x, i: (F.coalesce(F.get(s, i + 1).i, F.size(g)) - x.i).cast("long") * buckets + x.g))

    def placed(h: Column) -> Column:
        return F.pmod(h, F.lit(buckets)).cast("int")

    def of(joined: Column) -> Column:
        plain = F.transform(F.split(F.lower(joined), " "), lambda w: placed(F.xxhash64(w, F.lit(1))))
        folded = let(F.split(shapes(joined), " "), lambda s: F.concat(F.transform(s, lambda w: placed(F.xxhash64(w))), F.transform(s, lambda w, i: placed(F.xxhash64(w, F.coalesce(F.get(s, i + 1), F.lit("")))))))
        return let(F.sort_array(F.concat(plain, folded)), runs)

    return F.when(F.size(words) > 0, let(F.array_join(words, " "), of)).otherwise(F.array().cast("array<bigint>"))


def unpacked(v: Column, buckets: int) -> tuple[Column, Column]:
    """The bucket number and the count in an entry of grams()."""
    return F.pmod(v, F.lit(buckets)).cast("int"), ((v - F.pmod(v, F.lit(buckets))) / buckets).cast("long")


def measure(docs: DataFrame, buckets: int = 16384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, grams), written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))), lambda s: (F.size(s) - F.size(F.array_distinct(s))).cast("long"))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            let(window_hashes(w), covered).cast("long").alias("n_repeat_words"),
            grams(w, buckets).alias("grams"),
        )

    df = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        let(words_of(text), counts).alias("c"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("n_dup_lines"),
    )
    return materialise(df.select("row", "doc_id", "c.n_words", "c.word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words", "c.grams"), "measured")


def ratios(measured: DataFrame, trusted: DataFrame, buckets: int = 16384) -> list[float]:
    """log(p_target / p_raw) of each bucket; trusted has the doc_id of the trusted texts. At most 2 ``buckets`` rows reach the driver."""

    def counts(some: DataFrame) -> dict[int, int]:
        g, c = unpacked(F.col("v"), buckets)
        return {r.g: r.n for r in some.select(F.explode("grams").alias("v")).groupBy(g.alias("g")).agg(F.sum(c).alias("n")).collect()}

    raw = counts(measured)
    ids = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct().hint("merge")  # they grow with the input: never broadcast
    target = counts(measured.select("doc_id", "grams").join(ids, "doc_id", "left_semi"))
    all_raw, all_target = sum(raw.values()), sum(target.values())
    if not all_target:
        return [0.0] * buckets
    return [math.log((target.get(g, 0) + 1) / (all_target + buckets)) - math.log((raw.get(g, 0) + 1) / (all_raw + buckets)) for g in range(buckets)]


def judge(measured: DataFrame, table: list[float], threshold: float = -0.1) -> DataFrame:
    """Adds llr, base_failed and kept."""
    weights = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")  # folded to a constant
    of = lambda x: unpacked(x, len(table))
    n = 3 * F.col("n_words")  # a word, a shape and a pair of shapes for each word
    llr = F.when(n > 0, F.aggregate("grams", F.lit(0.0), lambda a, x: a + F.get(weights, of(x)[0]) * of(x)[1]) / n).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.withColumn("llr", F.round(llr, 9)).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))


def quality_rules(docs: DataFrame, trusted: DataFrame, buckets: int = 16384, threshold: float = -0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base counts, ratio and verdict of every row of docs."""
    measured = measure(docs, buckets, id_col, text_col)
    return judge(measured, ratios(measured, trusted, buckets), threshold).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )
