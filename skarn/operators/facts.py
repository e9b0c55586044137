"""Numeric facts: filters, access, verification, dashboards, subscriptions and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skarn.functions import text as T

ROLES = ("researcher", "analyst", "manager", "admin", "external_partner")


def passes(f: dict) -> Column:
    """Condition of fact filters; a missing confidence counts 0.5, a missing year passes, a missing place is WORLD. Needs a column geo."""
    confidence = F.coalesce("confidence", F.lit(0.5))
    level = F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")
    any_of = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower("canon"), w))
    out = F.lit(True)
    out = out & (confidence >= f["min_confidence"]) if f.get("min_confidence") is not None else out
    out = out & level.isin(f["confidence"]) if f.get("confidence") else out
    out = out & (F.col("year").isNull() | (F.col("year") >= f["year_from"])) if f.get("year_from") else out
    out = out & (F.col("year").isNull() | (F.col("year") <= f["year_to"])) if f.get("year_to") else out
    out = out & F.coalesce("geo", F.lit("WORLD")).isin(f["geo"]) if f.get("geo") else out
    for key in ("material", "process"):
        out = out & any_of(f[key]) if f.get(key) else out
    return out


def describe(f: dict) -> str | None:
    """Filters in words."""
    names = {"min_confidence": "достоверность от", "confidence": "достоверность", "year_from": "с года", "year_to": "по год", "geo": "география", "material": "материал", "process": "процесс"}
    said = [f"{n}: {', '.join(map(str, v)) if isinstance(v, list) else v}" for k, n in names.items() if (v := f.get(k)) not in (None, [], "")]
    return "; ".join(said) or None


def visible(role: str) -> Column:
    """External partners see public facts only; a missing sensitivity is public."""
    if role not in ROLES:
        raise ValueError(f"unknown role {role}")
    return F.coalesce("sensitivity", F.lit("public")) == "public" if role == "external_partner" else F.lit(True)


def with_kind(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs (doc_a, doc_b, ...) with kind: ru_vs_world if one document is from RU and one from WORLD, else method_vs_method."""
    geo = lambda n: docs.select(F.col("doc_id").alias(f"doc_{n}"), F.col("geo").alias(f"geo_{n}"))
    two = pairs.join(geo("a"), "doc_a", "left").join(geo("b"), "doc_b", "left")
    sides = F.coalesce(F.array_sort(F.array("geo_a", "geo_b")) == F.array(F.lit("RU"), F.lit("WORLD")), F.lit(False))
    return two.withColumn("kind", F.when(sides, "ru_vs_world").otherwise("method_vs_method")).drop("geo_a", "geo_b")


def of_kind(contradictions: DataFrame, kind: str | None) -> DataFrame:
    return contradictions.where(F.col("kind") == kind) if kind else contradictions


_SAME = ("metric", "canon", "phase", "unit")


def _relation(agree: float, differ: float) -> Column:
    gap = F.try_divide(F.abs(F.col("value_a") - F.col("value_b")), F.greatest(F.abs("value_a"), F.abs("value_b")))  # null: both are 0
    return F.when(F.coalesce(gap, F.lit(0.0)) <= agree, "VALIDATED_BY").when(gap > differ, "CONTRADICTS")


def value_classes(facts: DataFrame) -> DataFrame:
    """(metric, canon, phase, unit, value, n, least_doc, last_doc): facts of one key and value as one class; facts without a value are left out."""
    facts = facts.where("value_low IS NOT NULL")
    key = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in _SAME]
    return facts.groupBy(*key, F.col("value_low").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least_doc"), F.max("doc_id").alias("last_doc"))


def verify_classes(facts: DataFrame, agree: float = 0.1, differ: float = 0.2) -> DataFrame:
    """(metric, canon, phase, unit, value_a, value_b, n_a, n_b, doc_a, doc_b, rel): verify() between classes of equal values.

    value_a <= value_b; a class that several documents hold agrees with itself. doc_a and doc_b are a pair
    of documents that shows the link. Copies of a value cost one row, however many there are.
    """
    classes = value_classes(facts)
    side = lambda n: classes.select(*_SAME, *[F.col(c).alias(f"{c}_{n}") for c in ("value", "n", "least_doc", "last_doc")])
    pairs = side("a").join(side("b"), list(_SAME)).where("value_a <= value_b AND (least_doc_a <> last_doc_b OR last_doc_a <> least_doc_b)").withColumn("rel", _relation(agree, differ)).where("rel IS NOT NULL")
    straight = F.col("least_doc_a") != F.col("last_doc_b")
    return pairs.select(*_SAME, "value_a", "value_b", "n_a", "n_b", F.when(straight, F.col("least_doc_a")).otherwise(F.col("last_doc_a")).alias("doc_a"), F.when(straight, F.col("last_doc_b")).otherwise(F.col("least_doc_b")).alias("doc_b"), "rel")


def verify_counts(facts: DataFrame, agree: float = 0.1, differ: float = 0.2) -> DataFrame:
    """(rel, n): how many pairs verify() would list, counted from classes: all pairs of facts less those of one document."""
    rows = facts.where("value_low IS NOT NULL").select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in _SAME], "doc_id", F.col("value_low").alias("value"))

    def pairs(key: list[str]) -> DataFrame:
        one = rows.groupBy(*key, "value").agg(F.count(F.lit(1)).alias("n"))
        side = lambda x: one.select(*key, F.col("value").alias(f"value_{x}"), F.col("n").alias(f"n_{x}"))
        met = side("a").join(side("b"), key).where("value_a <= value_b").withColumn("rel", _relation(agree, differ)).where("rel IS NOT NULL")
        return met.select("rel", F.when(F.col("value_a") < F.col("value_b"), F.col("n_a") * F.col("n_b")).otherwise((F.col("n_a") * (F.col("n_a") - 1) / 2).cast("long")).alias("n"))

    own = pairs([*_SAME, "doc_id"]).select("rel", (-F.col("n")).alias("n"))
    return pairs(list(_SAME)).unionByName(own).groupBy("rel").agg(F.sum("n").alias("n")).where("n > 0")


def verify(facts: DataFrame, agree: float = 0.1, differ: float = 0.2) -> DataFrame:
    """Pairs of facts of the same metric, subject, phase and unit from different documents that agree or contradict.

    This lists every pair, so it is for facts that a question has selected; for a whole corpus
    verify_classes() gives each pair of values once and verify_counts() the numbers.
    """
    side = lambda n: facts.where("value_low IS NOT NULL").select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in _SAME], F.col("doc_id").alias(f"doc_{n}"), F.col("value_low").alias(f"value_{n}"))
    return side("a").join(side("b"), list(_SAME)).where("doc_a < doc_b").withColumn("rel", _relation(agree, differ)).where("rel IS NOT NULL")


def experiments(facts: DataFrame) -> DataFrame:
    """Facts of one document under the same conditions, as one experiment."""
    return facts.groupBy("doc_id", F.coalesce("phase", F.lit("")).alias("conditions")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("canon", "metric", "value_low", "value_high", "unit"))).alias("facts"))


def dashboard(docs: DataFrame) -> DataFrame:
    """(dimension, value, n): documents by category, geography and year, and in all, by grouping sets in one pass."""
    g = docs.groupingSets([["category"], ["geography"], ["year"], []], "category", "geography", "year").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "geography").when(F.col("g") == 6, "year").otherwise("total")
    rows = g.select(name.alias("dimension"), F.coalesce("category", "geography", F.col("year").cast("string")).alias("value"), "n")
    return rows.where("dimension <> 'year' OR (value IS NOT NULL AND value <> '0')")


def summary(docs: DataFrame, facts: DataFrame, experts: DataFrame, contradictions: DataFrame) -> dict:
    """Twelve figures over documents (doc_id, geo, domains), facts, experts and contradictions."""
    with_facts = docs.join(facts.select("doc_id").distinct().withColumn("has", F.lit(True)), "doc_id", "left")
    is_ = lambda g: F.count(F.when(F.col("geo") == g, 1))
    d = with_facts.agg(F.count(F.lit(1)).alias("docs"), is_("RU").alias("ru"), is_("WORLD").alias("world"), F.count(F.when(F.col("geo").isNull(), 1)).alias("geo_unknown"), F.count("has").alias("docs_with_facts")).first().asDict()
    share = lambda x: round(x / d["docs"], 4) if d["docs"] else 0.0
    more = {"facts": facts.count(), "experts": experts.count(), "contradictions": contradictions.count(), "domains": docs.select(F.explode("domains").alias("x")).distinct().count()}
    return d | more | {"ru_share": share(d["ru"]), "world_share": share(d["world"]), "fact_coverage": share(d["docs_with_facts"])}


def coverage(docs: DataFrame, facts: DataFrame, by: Column | str) -> DataFrame:
    """(key, docs, facts) by a column of documents, such as explode("domains"), year or geo."""
    n = facts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = docs.select((F.col(by) if isinstance(by, str) else by).alias("key"), "doc_id").join(n, "doc_id", "left")
    return rows.groupBy("key").agg(F.countDistinct("doc_id").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("facts"))


def top_problems(contradicted: DataFrame, gaps: DataFrame, most: int = 5) -> DataFrame:
    """(kind, a, b, spread): the widest contradictions and the first gaps of a dashboard."""
    wide = contradicted.orderBy(F.desc("spread"), "src", "dst").limit(most).select(F.lit("contradiction").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "spread")
    return wide.unionByName(gaps.orderBy("process", "material").limit(most).select(F.lit("gap").alias("kind"), F.col("process").alias("a"), F.col("material").alias("b"), F.lit(None).cast("double").alias("spread")))


def contradicted_subjects(facts: DataFrame, docs: DataFrame, agree: float = 0.1, differ: float = 0.2) -> DataFrame:
    """(canon, pairs, ru_vs_world): subjects with contradicting values, and whether some pair is of a document from RU and one from WORLD."""
    against = with_kind(verify_classes(facts, agree, differ).where("rel = 'CONTRADICTS'"), docs)
    return against.groupBy("canon").agg(F.count(F.lit(1)).alias("pairs"), F.bool_or(F.col("kind") == "ru_vs_world").alias("ru_vs_world"))


def risk_zones(facts: DataFrame, docs: DataFrame) -> DataFrame:
    """Subjects with a single source, or with sources from one side only. (canon, docs, low_sources, only_ru, only_world)

    The zone of contradictions is contradicted_subjects().
    """
    rows = facts.join(docs.select("doc_id", "geo"), "doc_id", "left")
    side = lambda g: F.coalesce(F.bool_and(F.col("geo") == g), F.lit(False))
    out = rows.groupBy("canon").agg(F.countDistinct("doc_id").alias("docs"), side("RU").alias("only_ru"), side("WORLD").alias("only_world"))
    return out.withColumn("low_sources", F.col("docs") == 1).where("low_sources OR only_ru OR only_world")


def activity(facts: DataFrame, limit: int = 20, experts: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, facts, last_extracted) of the documents last worked on; with experts (name, doc_ids) how many each has, with docs its year and geo."""
    out = facts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("facts"), F.max("extracted_at").alias("last_extracted")).orderBy(F.desc("last_extracted"), "doc_id").limit(limit)
    if experts is not None:
        n = experts.select("name", F.explode("doc_ids").alias("doc_id")).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("experts"))
        out = out.join(n, "doc_id", "left").withColumn("experts", F.coalesce("experts", F.lit(0)))
    return out if docs is None else out.join(docs.select("doc_id", "year", "geo"), "doc_id", "left")


def expert_coverage(experts: DataFrame, limit: int = 20) -> DataFrame:
    """(name, documents, domains, domain_list) from (name, doc_ids, domains); documents are counted, domains, a short vocabulary, listed."""
    documents = experts.select("name", F.explode_outer("doc_ids").alias("d")).groupBy("name").agg(F.count_distinct("d").cast("int").alias("documents"))
    listed = experts.select("name", F.explode_outer("domains").alias("d")).groupBy("name").agg(F.array_sort(F.collect_set("d")).alias("domain_list"))
    each = documents.orderBy(F.desc("documents"), "name").limit(limit).join(listed, "name")
    return each.select("name", "documents", F.size("domain_list").alias("domains"), "domain_list").orderBy(F.desc("documents"), "name")


def compared(facts: DataFrame, axes: list[str], by: str = "process", axis: str = "metric", units: bool = False) -> DataFrame:
    """min, max and samples of each axis for each process; an axis without facts is null. units=True adds each axis's unit (the first by name)."""
    parts = [F.min("value_low").alias("min"), F.max("value_high").alias("max"), F.count("value_low").alias("samples")]
    return facts.groupBy(by).pivot(axis, axes).agg(*parts, *([F.min("unit").alias("unit"), T.unit_label(F.min("unit")).alias("unit_label")] if units else []))


def unavailable(facts: DataFrame, axes: list[str], axis: str = "metric") -> DataFrame:
    """(axis): axes on which there are no facts at all, in the order given."""
    asked = facts.sparkSession.createDataFrame(list(enumerate(axes)), "k int, axis string")
    return asked.join(facts.select(F.col(axis).alias("axis")).distinct(), "axis", "left_anti").orderBy("k").select("axis")


def filter_options(facts: DataFrame, docs: DataFrame, most: int = 200) -> dict[str, DataFrame]:
    """The values that filters offer; processes only where facts name one."""
    one = lambda df, c: df.select(c).where(F.col(c).isNotNull()).distinct()
    out = {"years": one(facts, "year").orderBy(F.desc("year")), "geos": one(docs, "geo").orderBy("geo"), "materials": one(facts, "canon").orderBy("canon").limit(most)}
    return out | ({"processes": one(facts, "process").orderBy("process").limit(most)} if "process" in facts.columns else {})


def subscriptions(log: DataFrame) -> DataFrame:
    """(user, query, last_seen) still subscribed, from events (user, query, action, at): subscribe, unsubscribe, seen."""
    last = log.groupBy("user", "query").agg(F.max_by("action", F.when(F.col("action") != "seen", F.col("at"))).alias("state"), F.max(F.when(F.col("action") != "unsubscribe", F.col("at"))).alias("last_seen"))
    return last.where("state = 'subscribe'").select("user", "query", "last_seen")


def notifications(subscribed: DataFrame, facts: DataFrame, sample: int = 3, block: int = 1000) -> DataFrame:
    """(user, query, n, sample): facts on the subject of a subscription extracted since it was last seen; sample: the newest.

    The distinct queries are put to the distinct subjects in blocks; facts then meet subscriptions by
    equality of the subject.
    """
    asked = sorted({r.query for r in subscribed.select("query").distinct().collect()})
    subjects, met = facts.select("canon").distinct(), None
    for k in range(0, max(1, len(asked)), block):
        some = F.array(*[F.lit(q) for q in asked[k : k + block]]).cast("array<string>")
        one = subjects.select("canon", F.explode(F.filter(some, lambda q: F.contains(F.lower("canon"), F.lower(q)))).alias("query"))
        met = one if met is None else met.unionByName(one)
    new = facts.join(subscribed.join(met, "query"), "canon").where(F.col("extracted_at") > F.col("last_seen"))
    rank = F.row_number().over(W.partitionBy("user", "query").orderBy(F.desc("extracted_at"), "doc_id", "canon"))
    count = new.groupBy("user", "query").agg(F.count(F.lit(1)).alias("n"))
    some = new.withColumn("k", rank).where(F.col("k") <= sample).groupBy("user", "query").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "canon"))), lambda x: x.canon).alias("sample"))
    return count.join(some, ["user", "query"])


def audit_tail(log: DataFrame, limit: int = 50, event: str | None = None) -> DataFrame:
    return (log.where(F.col("event") == event) if event else log).orderBy(F.desc("at"), F.desc("id")).limit(limit)


def history(log: DataFrame, limit: int = 8) -> DataFrame:
    """The latest distinct queries."""
    return log.groupBy("query").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "query").limit(limit)


def reference_rows(facts: DataFrame, named: list[str], units: list[str] | None = None, max_value: float | None = None, year_from: int | None = None) -> DataFrame:
    """Rows of a ready-made report: facts whose subject or phase holds one of the names.

    A fact without a value fails a bound on values; one without a year passes a bound on years.
    """
    low = F.lower(F.concat_ws(" ", "canon", "phase"))
    keep = F.exists(F.array(*[F.lit(x.lower()) for x in named]).cast("array<string>"), lambda x: F.contains(low, x))
    if units:
        keep &= F.col("unit").isin(units)
    if max_value is not None:
        keep &= F.coalesce("value_high", "value_low") <= max_value
    if year_from is not None:
        keep &= F.col("year").isNull() | (F.col("year") >= year_from)
    return facts.where(keep).select(F.col("canon").alias("material"), "phase", "metric", "value_low", "value_high", "unit", "quote", "doc_id", "year")


def desalination(facts: DataFrame, max_sulfate: float = 300) -> DataFrame:
    """Sulfate contents up to a bound in mg/l."""
    return reference_rows(facts, ["сульфат", "sulfate"], ["mg_per_l", "mg_l", "мг/л", "mg/l"], max_sulfate)


def catholyte(facts: DataFrame) -> DataFrame:
    return reference_rows(facts, ["католит", "catholyte"])


def precious_metals(facts: DataFrame, now: int, years: int = 5) -> DataFrame:
    """Gold, silver and platinum metals over the years before ``now``, this year's included."""
    return reference_rows(facts, ["золот", "gold", "серебр", "silver", "платин", "platinum", "паллади", "palladium", "мпг", "pgm"], year_from=now - years)
