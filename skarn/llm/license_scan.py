"""License texts in documents: base phrases, and an exact set-similarity join of text blocks with templates.

A block is a line of the text, or a run of words over line ends that is at most 1 / ``threshold`` times as
long as the template (so that wrapped notices are found, and words scattered over a long text are not);
a template matches it if the block holds at least the share ``threshold`` of the template's distinct words.
Words are ordered over the whole corpus by how many documents hold them, rarest first. With that order:
a block that lacks the first |T| - ceil(threshold |T|) + 1 words of a template cannot match (prefix
filter); one with fewer template words than needed cannot (length filter); and once the place of the first
shared word is known on both sides, the words from there on must still suffice (positional filter). What
passes is counted exactly. For runs the filters are put to the text of several lines as a whole, which
holds all words of its runs, and the count to the runs themselves.
Templates are joined AT_ONCE at a time, so what is broadcast stays bounded for any number of them.

Defined results: null and empty texts have no words, labels or places; texts of any length are read whole;
a template that several blocks meet counts with the best; several labels are sorted by name; repeated rows
each get a row; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.common import let, materialise
from skarn.llm.license_texts import TEMPLATES

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# fixed values: base phrases and their labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates that are joined at once.
AT_ONCE = 1000


def tokens(text: Column) -> Column:
    """Words of the text with ASCII letters in lower case (lower() also folds other letters, which adds no ASCII word)."""
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "")


def _words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _need(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


def _list(words: list[str]) -> Column:
    return F.split(F.lit(" ".join(words)), " ")  # folded to a constant


def ordered(texts: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> tuple[list[str], list[tuple]]:
    """The templates' words, and (template, label, words, need, span, prefix, place) for each prefix word of each template.

    Words come by document frequency, rarest first, then by word; place counts from 0. The driver gets one
    count for each template word.
    """
    known = sorted({w for _, t in templates for w in _words(t)})
    held = texts.select(F.explode(F.array_intersect(tokens(F.coalesce("text", F.lit(""))), _list(known))).alias("w")).groupBy("w").count()
    often = {r.w: r["count"] for r in held.collect()}
    order = sorted(known, key=lambda w: (often.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    rows = []
    for k, (label, text) in enumerate(templates):
        words = sorted(set(_words(text)), key=rank.__getitem__)
        need = _need(len(words), threshold)
        rows += [(k, label, words, need, math.ceil(len(_words(text)) / threshold - 1e-9), w, p) for p, w in enumerate(words[: len(words) - need + 1])]
    return order, rows


def scan(texts: DataFrame, order: list[str], rows: list[tuple], phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(row, doc_id, n_words, places, blocks), written once.

    places: (start, label) of each phrase; blocks: for each line that holds a prefix word, and for a text of
    several lines as a whole, held: its template words in the corpus order; and hits: null for lines, else
    (at, w) of every template word of the text.
    """
    least = min((r[3] for r in rows), default=1)
    rare, vocabulary = _list(sorted({r[5] for r in rows})), _list(order)
    text = F.coalesce("text", F.lit(""))
    block = "array<struct<held:array<string>,hits:array<struct<at:int,w:string>>>>"
    nothing = F.array().cast(block)

    def of_lines(t: Column) -> Column:
        lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.split(F.lower(x), SEPARATORS)), lambda x: F.arrays_overlap(x, rare))
        held = F.transform(lines, lambda x: F.struct(F.array_intersect(vocabulary, x).alias("held"), F.lit(None).cast("array<struct<at:int,w:string>>").alias("hits")))
        return F.filter(held, lambda b: F.size(b.held) >= least)

    def of_text(w: Column) -> Column:
        hits = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("at"), x.alias("w"))), lambda h: F.array_contains(vocabulary, h.w))
        return F.array(F.struct(F.array_intersect(vocabulary, w).alias("held"), hits.alias("hits")))

    def found(w: Column) -> Column:
        def here(i: Column) -> Column:
            case = F.lit(None).cast("string")
            for phrase, label in phrases.items():
                same = None
                for k, part in enumerate(phrase.split(" ")):
                    one = F.coalesce(F.get(w, i + k) == part, F.lit(False))
                    same = one if same is None else same & one
                case = F.when(same, F.lit(label)).otherwise(case)
            return F.struct(i.cast("long").alias("start"), case.alias("label"))

        line = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
        some = F.lit(False)
        for phrase in phrases:
            some = some | F.contains(line, F.lit(f" {phrase} "))
        at = F.filter(F.transform(F.sequence(F.lit(0), F.size(w) - 1), here), lambda x: x.label.isNotNull())
        wide = F.when(F.contains(text, F.lit("\n")), of_text(w)).otherwise(nothing)
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.when(some, at).otherwise(F.array().cast("array<struct<start:bigint,label:string>>")).alias("places"),
            F.when(F.arrays_overlap(w, rare), F.concat(of_lines(text), wide)).otherwise(nothing).alias("blocks"),
        )

    df = texts.select("row", "doc_id", let(tokens(text), found).alias("f"))
    return materialise(df.select("row", "doc_id", "f.n_words", "f.places", "f.blocks"), "scanned")


def _most(hits: Column, words: Column, span: Column) -> Column:
    """The most distinct words of a template in any run of ``span`` words; a run starts at a template word."""
    own = F.filter(hits, lambda h: F.array_contains(words, h.w))

    def best(h: Column) -> Column:
        run = lambda x, k: F.filter(F.slice(h, k + 1, span), lambda y: y.at < x.at + span)
        return F.coalesce(F.array_max(F.transform(h, lambda x, k: F.size(F.array_distinct(F.transform(run(x, k), lambda y: y.w))))), F.lit(0))

    return let(own, best)


def matches(spark: SparkSession, scanned: DataFrame, rows: list[tuple]) -> DataFrame:
    """(row, label, score): every template label that some block of the row meets, with the best containment."""
    prefixes = F.broadcast(spark.createDataFrame(rows, "template int, label string, words array<string>, need int, span int, prefix string, place int"))
    blocks = scanned.select("row", F.posexplode("blocks").alias("b", "x")).select("row", "b", "x.held", "x.hits")
    each = blocks.where(F.size("held") > 0).select("row", "b", "held", "hits", F.posexplode("held").alias("i", "prefix"))
    pairs = each.join(prefixes, "prefix").where(F.size("held") >= F.col("need"))  # prefix and length
    first = pairs.where(~F.arrays_overlap(F.slice("words", F.lit(1), F.col("place")), "held"))  # once a pair: at its first shared word
    rest = first.where((F.size("held") - F.col("i") >= F.col("need")) & (F.size("words") - F.col("place") >= F.col("need")))  # positional
    n = F.when(F.col("hits").isNull() | (F.size(F.array_intersect("words", "held")) < F.col("need")), F.size(F.array_intersect("words", "held"))).otherwise(_most(F.col("hits"), F.col("words"), F.col("span")))
    counted = rest.select("row", "label", "need", F.size("words").alias("of"), n.alias("n")).where(F.col("n") >= F.col("need"))
    return counted.groupBy("row", "label").agg(F.max(F.col("n") / F.col("of")).alias("score"))


def licenses(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base places and labels, all labels and the best score of every row of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    groups = [templates[k : k + AT_ONCE] for k in range(0, len(templates), AT_ONCE)] or [()]
    if len(groups) > 1:
        texts = materialise(texts, "texts")  # so that row numbers hold over the groups
    scanned = found = None
    for group in groups:
        order, rows = ordered(texts, group, threshold)
        one = scan(texts, order, rows, phrases)
        more = matches(spark, one, rows)
        scanned, found = (one, more) if scanned is None else (scanned, found.unionByName(more))
    by_row = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    base = F.sort_array(F.array_distinct(F.transform("places", lambda p: p.label)))
    start = F.transform("places", lambda p: p.start)
    return scanned.join(by_row, "row", "left").select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.sort_array(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
