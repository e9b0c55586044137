"""Scalar functions of documents as column expressions, and their registration for SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from skarn import lexicon as L

SPACES = r"[\s\p{Z}]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_c(c), rf"^{SPACES}+|{SPACES}+$", "")


def doc_id(path: Column | str) -> Column:
    return F.substring(F.md5(_c(path).cast("binary")), 1, 16)


def chunk_id(doc: Column | str, idx: Column | str) -> Column:
    return F.format_string("%s_%04d", _c(doc), _c(idx).cast("int"))


def _count(c: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(c, kept, ""))


def language(text: Column | str) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    return F.when(_count(t, "[^Ѐ-ӿ]") > 0.5 * _count(t, "[^A-Za-z]"), "ru").otherwise("en")


def geography(text: Column | str, filename: Column | str | None = None, home: list[str] = L.HOME, foreign: list[str] = L.FOREIGN) -> Column:
    name = _c(filename) if filename is not None else F.lit("")
    low = F.lower(F.concat(F.coalesce(_c(text), F.lit("")), F.lit(" "), F.coalesce(name, F.lit(""))))
    has = lambda markers: reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in markers])
    return F.when(has(home) & has(foreign), "Global").when(has(home), "Russia").when(has(foreign), "Foreign").otherwise("Unknown")


def year(text: Column | str, filename: Column | str | None = None) -> Column:
    found = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(20[0-2][0-9]|19[89][0-9])", 1), F.lit(""))
    name = _c(filename) if filename is not None else F.lit("")
    return F.coalesce(found(name), found(F.substring(_c(text), 1, 3000))).cast("int")


def _lines(text: Column, chars: int) -> Column:
    return F.filter(F.transform(F.split(F.substring(F.coalesce(text, F.lit("")), 1, chars), "\n"), strip), lambda x: x != "")


def stem(filename: Column | str) -> Column:
    """A file's name without folders and extension."""
    base = F.regexp_extract(F.coalesce(_c(filename), F.lit("")), r"([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", "")


def title(text: Column | str, filename: Column | str | None = None) -> Column:
    def good(x: Column) -> Column:
        low = F.lower(x)
        return (F.length(x) > 15) & ~reduce(lambda a, b: a | b, [F.startswith(low, F.lit(p)) for p in L.NO_TITLE])

    name = _c(filename) if filename is not None else F.lit("")
    return F.substring(F.coalesce(F.get(F.filter(F.slice(_lines(_c(text), 2000), 1, 15), good), F.lit(0)), stem(name)), 1, 200)


def authors(text: Column | str) -> Column:
    initial = lambda up, low: F.lit(rf"([{up}][{low}]+(?:\s+[{up}]\.?(?:\s*[{up}]\.?)?))")
    cyrillic, latin = initial("А-ЯЁ", "а-яё"), initial("A-Z", "a-z")
    found = F.transform(
        F.slice(_lines(_c(text), 1500), 1, 5),
        lambda x: F.when(F.length(x) < 300, F.concat(F.slice(F.regexp_extract_all(x, cyrillic, 1), 1, 10), F.slice(F.regexp_extract_all(x, latin, 1), 1, 10))).otherwise(F.array().cast("array<string>")),
    )
    return F.slice(F.coalesce(F.get(F.filter(found, lambda a: F.size(a) > 0), F.lit(0)), F.array().cast("array<string>")), 1, 10)


def category(path: Column | str) -> Column:
    """struct(category, source_type) of a path, by the first folder that names one."""
    known = F.create_map(*[x for k, (a, b) in L.CATEGORIES.items() for x in (F.lit(k), F.struct(F.lit(a).alias("category"), F.lit(b).alias("source_type")))])
    first = F.get(F.filter(F.split(_c(path), "/"), lambda x: x.isin(*L.CATEGORIES)), F.lit(0))
    pdf = F.endswith(F.lower(_c(path)), F.lit(".pdf"))
    other = F.when(pdf, F.struct(F.lit("article").alias("category"), F.lit("scientific_article").alias("source_type"))).otherwise(F.struct(F.lit("report").alias("category"), F.lit("internal_report").alias("source_type")))
    return F.coalesce(F.try_element_at(known, F.coalesce(first, F.lit(""))), other)


def trust(source_type: Column | str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in L.TRUST.items() for x in kv]), F.coalesce(_c(source_type), F.lit(""))), F.lit(1))


def trust_stars(n: Column | str) -> Column:
    g = F.greatest(_c(n).cast("int"), F.lit(0))
    return F.concat(F.repeat(F.lit("★"), g), F.repeat(F.lit("☆"), F.greatest(5 - g, F.lit(0))))


def normalize_term(term: Column | str, lexicon: L.Lexicon = L.DEFAULT) -> Column:
    known = F.create_map(*[F.lit(x) for kv in lexicon.aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(strip(term))), strip(term))


def confidence_label(x: Column | str) -> Column:
    v = F.coalesce(_c(x), F.lit(0.5))
    return F.when(v >= 0.8, "высокая").when(v >= 0.5, "средняя").otherwise("низкая")


# fixed values: display forms of canonical units
UNIT_LABELS = {"mg_per_l": "мг/л", "g_per_l": "г/л", "percent": "%", "celsius": "°C", "m_per_s": "м/с", "t_per_day": "т/сут", "m3_per_h": "м³/ч", "rub_per_t": "руб/т"}


def unit_label(unit: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for kv in UNIT_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.coalesce(_c(unit), F.lit(""))), _c(unit))


def plain_number(x: Column) -> Column:
    """A number without a fraction of zeros and without an exponent."""
    v = x.cast("double")
    far = (F.abs(v) >= 1e7) | (F.abs(v) < 1e-3) & (v != 0)  # written with an exponent otherwise
    return F.regexp_replace(F.when(far, F.regexp_replace(v.cast("decimal(38,12)").cast("string"), r"(\.\d*?)0+$", "$1")).otherwise(v.cast("string")), r"\.0?$", "")


def value_label(low: Column | str, high: Column | str, unit: Column | str) -> Column:
    lo, hi = _c(low), F.coalesce(_c(high), _c(low))
    body = F.when(lo == hi, plain_number(lo)).otherwise(F.concat(plain_number(lo), F.lit("–"), plain_number(hi)))
    return F.concat_ws(" ", body, unit_label(unit))


def compact_number(n: Column | str) -> Column:
    v = _c(n).cast("double")
    return F.when(F.abs(v) >= 1e6, F.concat(plain_number(F.round(v / 1e6, 1)), F.lit(" млн"))).when(F.abs(v) >= 1e3, F.concat(plain_number(F.round(v / 1e3, 1)), F.lit(" тыс."))).otherwise(plain_number(v))


def ocr_normalised(text: Column | str) -> Column:
    """Look-alike Latin letters inside Cyrillic words, hyphens at line ends, runs of spaces."""
    t = F.regexp_replace(_c(text), r"(\p{L})-\n(\p{L})", "$1$2")
    for latin, cyrillic in zip("aceopxyABCEHKMOPTX", "асеорхуАВСЕНКМОРТХ"):
        t = F.regexp_replace(t, rf"(?<=[Ѐ-ӿ]){latin}|{latin}(?=[Ѐ-ӿ])", cyrillic)
    return strip(F.regexp_replace(t, r"[ \t]+", " "))


def without_running_heads(pages: Column | str, least: int = 3) -> Column:
    """Pages without running heads and feet: the first or last line of a page where half of the pages or more, and ``least`` at the least, have it."""
    body = lambda p: F.filter(F.split(F.coalesce(p, F.lit("")), "\n"), lambda x: strip(x) != "")

    def cleaned(all_: Column) -> Column:
        ends = F.flatten(F.transform(all_, lambda p: F.array_distinct(F.filter(F.array(strip(F.get(body(p), F.lit(0))), strip(F.get(F.reverse(body(p)), F.lit(0)))), lambda x: x.isNotNull()))))
        often = F.filter(F.array_distinct(ends), lambda e: F.size(F.filter(ends, lambda x: x == e)) >= F.greatest(F.lit(least), F.ceil(F.size(all_) / 2)))
        drop = lambda p, o: F.array_join(F.filter(F.split(F.coalesce(p, F.lit("")), "\n"), lambda x: ~F.array_contains(o, strip(x))), "\n")
        return F.transform(F.array(often), lambda o: F.transform(all_, lambda p: drop(p, o)))[0]

    return F.transform(F.array(_c(pages)), lambda a: cleaned(a))[0]


def content_md5(text: Column | str) -> Column:
    return F.md5(F.lower(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\s+", " ")).cast("binary"))


def tokens(text: Column | str) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("([а-яёa-z0-9]+)"), 1), lambda x: F.length(x) > 1)


def file_slug(name: Column | str, day: Column | str, extension: str) -> Column:
    slug = F.regexp_replace(F.substring(F.regexp_replace(F.lower(_c(name)), "[^a-zа-яё0-9]+", "-"), 1, 54), "^-+|-+$", "")
    return F.concat(_c(day).cast("string"), F.lit("-"), F.when(slug == "", "research").otherwise(slug), F.lit(f".{extension}"))


def register(spark: SparkSession) -> None:
    """SQL functions that Catalyst expands in place: no Python runs in them."""
    sql = {
        "kg_detect_language(t STRING) RETURNS STRING": "CASE WHEN length(regexp_replace(coalesce(t,''), '[^\\\\u0400-\\\\u04ff]', '')) > 0.5 * length(regexp_replace(coalesce(t,''), '[^A-Za-z]', '')) THEN 'ru' ELSE 'en' END",
        "kg_extract_year(t STRING) RETURNS INT": "cast(nullif(regexp_extract(substring(t, 1, 3000), '(20[0-2][0-9]|19[89][0-9])', 1), '') AS INT)",
        "kg_tokenize(t STRING) RETURNS ARRAY<STRING>": "filter(regexp_extract_all(lower(coalesce(t,'')), '([а-яёa-z0-9]+)', 1), x -> length(x) > 1)",
        "kg_trust_stars(n INT) RETURNS STRING": "concat(repeat('★', greatest(n, 0)), repeat('☆', greatest(5 - greatest(n, 0), 0)))",
        "kg_confidence_label(x DOUBLE) RETURNS STRING": "CASE WHEN coalesce(x, 0.5) >= 0.8 THEN 'высокая' WHEN coalesce(x, 0.5) >= 0.5 THEN 'средняя' ELSE 'низкая' END",
    }
    for head, body in sql.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    bare = "regexp_replace(t, '^[\\\\s\\\\p{Z}]+|[\\\\s\\\\p{Z}]+$', '')"
    table = ", ".join(f"'{k}', '{v}'" for k, v in L.DEFAULT.aliases.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION kg_normalize_term(t STRING) RETURNS STRING RETURN coalesce(try_element_at(map({table}), lower({bare})), {bare})")
