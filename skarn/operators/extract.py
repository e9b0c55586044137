"""Entities, values with units and relations found in chunks of text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.text import normalize_term
from skarn.lexicon import DEFAULT, Lexicon

MENTION = "array<struct<ord:int,type:string,name:string,canonical:string,value_low:double,value_high:double,unit:string>>"


def keyword_mentions(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Each keyword that the text holds, first of each (type, canonical) in lexicon order.

    The lexicon is a constant array that each row filters: no rows are multiplied.
    """
    rows = [(t, w, lexicon.canonical(w)) for t, words in lexicon.keywords.items() for w in words]
    known = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(t).alias("type"), F.lit(w).alias("name"), F.lit(c).alias("canonical")) for k, (t, w, c) in enumerate(rows)])
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.transform(F.array(low), lambda x: F.filter(known, lambda k: F.contains(x, k["name"])))[0]
    first = F.transform(F.array(found), lambda a: F.filter(a, lambda x: ~F.exists(a, lambda y: (y.ord < x.ord) & (y.type == x.type) & (y.canonical == x.canonical))))[0]
    return F.transform(first, lambda x: F.struct(x.ord.alias("ord"), x.type.alias("type"), x["name"].alias("name"), x.canonical.alias("canonical"), F.lit(None).cast("double").alias("value_low"), F.lit(None).cast("double").alias("value_high"), F.lit(None).cast("string").alias("unit")))


# fixed values: signs of comparison, and dashes between the ends of a range
COMPARED, DASHES = ("<", ">", "<=", ">=", "≤", "≈", "~"), "-–—"
_MARK, _FIELD = "\ue000", "\ue001"
_AROUND = 50


def value_pattern(units: list[str]) -> str:
    """A number or a range of numbers and a unit; longer units win. Groups: low, high, unit."""
    number = r"([0-9]+(?:[.,][0-9]+)?)"
    sign = "|".join(sorted(COMPARED, key=len, reverse=True))
    return rf"(?:{sign})?\s*{number}\s*(?:[{DASHES}]\s*{number}\s*)?({'|'.join(map(re.escape, sorted(units, key=len, reverse=True)))})"


def numeric_values(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """Numbers and ranges with a unit, named by a parameter keyword in the 50 characters before.

    Matches are set off by marks and the text is split at them, so all of it stays in the JVM. The two
    private-use characters that serve as marks count as spaces where a text holds them.
    """
    named = F.array(*[F.struct(F.lit(p).alias("word"), F.lit(lexicon.canonical(p)).alias("canonical")) for p in lexicon.keywords.get("Parameter", [])] or [F.struct(F.lit(_MARK).alias("word"), F.lit("").alias("canonical"))])
    plain = F.translate(F.coalesce(text, F.lit("")), _MARK + _FIELD, "  ")
    marked = F.regexp_replace(plain, "(?iu)" + value_pattern(lexicon.units), _FIELD.join((_MARK + "$0", "$1", "$2", "$3" + _MARK)))

    def found(parts: Column) -> Column:
        # odd parts are matches; a match has two characters at least, so the 50 before it lie in as many parts
        def one(i: Column) -> Column:
            near = F.transform(F.slice(parts, F.greatest(F.lit(1), i - _AROUND + 1), F.least(i, F.lit(_AROUND))), lambda x: F.substring_index(x, _FIELD, 1))
            before = F.lower(F.right(F.array_join(near, ""), F.lit(_AROUND)))
            return F.struct(i.alias("i"), F.split(F.get(parts, i), _FIELD).alias("m"), F.get(F.filter(named, lambda p: F.contains(before, p.word)), F.lit(0)).canonical.alias("known"))

        number = lambda x: F.nullif(F.replace(x, F.lit(","), F.lit(".")), F.lit("")).cast("double")

        def mention(x: Column) -> Column:
            name = F.coalesce(x.known, F.concat(F.lit("parameter_"), F.get(x.m, 3)))
            low = number(F.get(x.m, 1))
            return F.struct(
                (F.lit(100_000) + F.floor((x.i - 1) / 2)).cast("int").alias("ord"), F.lit("Parameter").alias("type"), name.alias("name"), name.alias("canonical"),
                low.alias("value_low"), F.coalesce(number(F.get(x.m, 2)), low).alias("value_high"), F.get(x.m, 3).alias("unit"),
            )

        return F.when(F.size(parts) > 1, F.transform(F.transform(F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2)), one), mention)).otherwise(F.array().cast(MENTION))

    return F.transform(F.array(F.split(marked, _MARK)), lambda p: found(p))[0]


def mentions(chunks: DataFrame, lexicon: Lexicon = DEFAULT, keep_named_values: bool = False) -> DataFrame:
    """(chunk_id, doc_id, chunk_idx, ord, type, name, canonical, value_low, value_high, unit).

    One row for each (type, canonical) of a chunk, keywords before values. Since the keyword that names
    a value stands in the text itself, named values give way to it; keep_named_values keeps both.
    """
    each = chunks.select("id", "doc_id", "idx", F.concat(keyword_mentions(F.col("text"), lexicon), numeric_values(F.col("text"), lexicon)).alias("m"))
    same = F.filter("m", lambda x: ~F.exists("m", lambda y: (y.ord < x.ord) & (y.type == x.type) & (y.canonical == x.canonical) & (F.lit(not keep_named_values) | y.value_low.isNotNull())))
    return each.select("id", "doc_id", "idx", F.inline(same)).select(F.col("id").alias("chunk_id"), "doc_id", F.col("idx").alias("chunk_idx"), "ord", "type", "name", "canonical", "value_low", "value_high", "unit")


def relations(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_idx, ord, src, src_type, dst, dst_type, rel_type, value_low, value_high, unit, evidence) within each chunk.

    Mentions of a chunk are a short list, so its pairs are made inside the row, not by a self join.
    """
    m = F.struct("ord", "type", "canonical", "value_low", "value_high", "unit")
    per = found.groupBy("chunk_id", "doc_id", "chunk_idx").agg(F.array_sort(F.collect_list(m)).alias("m"))
    kinds = F.create_map(F.lit("Material"), F.lit("uses_material"), F.lit("Equipment"), F.lit("uses_equipment"), F.lit("Parameter"), F.lit("has_parameter"))
    pairs = F.flatten(
        F.transform(
            F.filter("m", lambda p: p.type == "Process"),
            lambda p: F.transform(
                F.filter("m", lambda o: (o.type.isin("Equipment")) | ((o.type == "Material") & (o.canonical != p.canonical)) | ((o.type == "Parameter") & o.value_low.isNotNull())),
                lambda o: F.struct(p.canonical.alias("src"), o.canonical.alias("dst"), o.type.alias("dst_type"), kinds[o.type].alias("rel_type"), o.value_low.alias("value_low"), o.value_high.alias("value_high"), o.unit.alias("unit")),
            ),
        )
    )
    flat = per.select("chunk_id", "doc_id", "chunk_idx", F.posexplode(pairs).alias("ord", "r")).select("chunk_id", "doc_id", "chunk_idx", "ord", "r.*")
    return flat.join(chunks.select(F.col("id").alias("chunk_id"), F.substring("text", 1, 200).alias("evidence")), "chunk_id").withColumn("src_type", F.lit("Process")).drop("chunk_id")


def json_from_reply(reply: str) -> dict | list:
    """The JSON in a model's reply: without code fences, else its outermost brackets, else {}."""
    text = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", reply or "")
    spans = [(text.find(a), text.rfind(b)) for a, b in ("{}", "[]")]
    for body in (text, *(text[a : b + 1] for a, b in sorted(spans) if 0 <= a < b)):
        try:
            return json.loads(body)
        except ValueError:
            continue
    return {}


# fixed values: kinds that a model may name
KINDS = ("Material", "Process", "Equipment", "Property", "Parameter", "Experiment", "Publication", "Expert", "Facility")


def prompt(text: str, limit: int = 3000) -> str:
    """What a model is asked about a text: entities and relations as JSON."""
    return (
        "Name the entities of the text and the relations between them. Answer with JSON only: "
        '{"entities": [{"type": ..., "name": ..., "canonical": ...}], "relations": [{"source": ..., "target": ..., "type": ...}]}. '
        f"Types of entities: {', '.join(KINDS)}.\n\nText:\n{text[:limit]}"
    )


def replies(chunks: DataFrame, ask: Callable[[str], str], every: int = 5, limit: int = 3000) -> DataFrame:
    """(chunk_id, doc_id, chunk_idx, reply) of each ``every``-th chunk: a model's JSON, {} where it fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for text in rows.pop("text"):
                try:
                    got = json_from_reply(ask(prompt(text or "", limit)))
                except Exception:  # a plug-in may fail in any way; its chunk then has no answer
                    got = {}
                out.append(json.dumps(got if isinstance(got, dict) else {}, ensure_ascii=False))
            yield rows.assign(reply=out)

    some = chunks.where(F.col("idx") % every == 0).select(F.col("id").alias("chunk_id"), "doc_id", F.col("idx").cast("int").alias("chunk_idx"), "text")
    return some.mapInPandas(run, f"chunk_id string, doc_id {dict(chunks.dtypes)['doc_id']}, chunk_idx int, reply string")


def model_mentions(chunks: DataFrame, ask: Callable[[str], str], every: int = 5, limit: int = 3000, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Mentions from a model that answers in JSON, for each ``every``-th chunk; a failed answer gives none."""
    return mentions_of_replies(replies(chunks, ask, every, limit), lexicon)


def mentions_of_replies(answered: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """(chunk_id, doc_id, chunk_idx, ord, type, name, canonical) of the entities in replies(); nameless ones are left out."""
    e = F.from_json(F.get_json_object("reply", "$.entities"), "array<struct<type:string,name:string,canonical:string>>")
    each = answered.select("chunk_id", "doc_id", "chunk_idx", F.posexplode(e).alias("k", "e")).where("e.name IS NOT NULL AND e.name <> ''")
    given = F.nullif(F.col("e.canonical"), F.lit(""))
    return each.select("chunk_id", "doc_id", "chunk_idx", (F.lit(200_000) + F.col("k")).cast("int").alias("ord"), F.coalesce(F.nullif(F.col("e.type"), F.lit("")), F.lit("Material")).alias("type"), F.col("e.name").alias("name"), F.coalesce(given, normalize_term(F.col("e.name"), lexicon)).alias("canonical"))


def relations_of_replies(answered: DataFrame, found: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """(doc_id, chunk_idx, ord, src, src_type, dst, dst_type, rel_type) of the relations in replies().

    An end's type is that of the chunk's mention of the name, else Process for the source and Material for the target.
    """
    r = F.from_json(F.get_json_object("reply", "$.relations"), "array<struct<source:string,target:string,type:string>>")
    each = answered.select("chunk_id", "doc_id", "chunk_idx", F.posexplode(r).alias("k", "r")).where("r.source <> '' AND r.target <> ''")
    flat = each.select("chunk_id", "doc_id", "chunk_idx", (F.lit(200_000) + F.col("k")).cast("int").alias("ord"), normalize_term(F.col("r.source"), lexicon).alias("src"), normalize_term(F.col("r.target"), lexicon).alias("dst"), F.coalesce(F.nullif(F.col("r.type"), F.lit("")), F.lit("related_to")).alias("rel_type"))
    kinds = found.groupBy("chunk_id", "canonical").agg(F.min_by("type", "ord").alias("kind"))
    side = lambda n: kinds.select("chunk_id", F.col("canonical").alias(n), F.col("kind").alias(f"{n}_kind"))
    typed = flat.join(side("src"), ["chunk_id", "src"], "left").join(side("dst"), ["chunk_id", "dst"], "left")
    return typed.select("doc_id", "chunk_idx", "ord", "src", F.coalesce("src_kind", F.lit("Process")).alias("src_type"), "dst", F.coalesce("dst_kind", F.lit("Material")).alias("dst_type"), "rel_type")


def with_model(found: DataFrame, extra: DataFrame) -> DataFrame:
    """Mentions of both, those of the model only where a chunk lacks the (type, canonical)."""
    return found.unionByName(extra.join(found, ["chunk_id", "type", "canonical"], "left_anti"), allowMissingColumns=True)


def extracted(chunks: DataFrame, lexicon: Lexicon = DEFAULT, ask: Callable[[str], str] | None = None, every: int = 5) -> tuple[DataFrame, DataFrame]:
    """(mentions, relations) of chunks; with a model, its entities where they are new and all its relations."""
    found = mentions(chunks, lexicon)
    related = relations(found, chunks)
    if ask is None:
        return found, related
    answered = replies(chunks, ask, every).cache()  # one question a chunk
    extra = mentions_of_replies(answered, lexicon)
    both = with_model(found, extra)
    return both, related.unionByName(relations_of_replies(answered, both, lexicon), allowMissingColumns=True)
