"""A property graph kept as evidence rows; nodes and edges are aggregates of them, queries are joins.

Evidence is append-only, so an incremental build is a union and gives what a full build gives.
Order is explicit: ``seq`` (any orderable type, such as a struct of path, chunk and place).
At corpus scale a node has one row in node_table() with counts, and its documents and names are rows of
provenance() and names(); nodes() and edges() hold these as lists, for graphs that are served.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.lexicon import DEFAULT, Lexicon


def node_id(kind: Column | str, canonical: Column | str) -> Column:
    return F.concat_ws(":", *[F.col(c) if isinstance(c, str) else c for c in (kind, canonical)])


def node_table(evidence: DataFrame) -> DataFrame:
    """(id, type, canonical, name, geography, n_names, n_sources, trust, properties): nodes() with counts instead of lists.

    Evidence is summed up by document first, so a node of very many documents is shuffled as one row a
    document and no row grows with the corpus.
    """
    key = ["type", "canonical"]
    by_doc = evidence.groupBy(*key, "doc_id").agg(F.min(F.struct("seq", "name")).alias("first"), F.min(F.when(F.col("geography").isNotNull(), F.struct("seq", "geography"))).alias("place"), F.max("trust").alias("trust"))
    base = by_doc.groupBy(*key).agg(F.min("first").alias("first"), F.min("place").alias("place"), F.max("trust").alias("trust"), F.count("doc_id").alias("n_sources"))
    n_names = names(evidence).groupBy(*key).agg(F.count("name").alias("n_names"))
    out = base.join(n_names, key).join(_properties(evidence), key, "left")
    return out.select(node_id("type", "canonical").alias("id"), *key, F.col("first.name").alias("name"), F.col("place.geography").alias("geography"), "n_names", "n_sources", "trust", "properties")


def names(evidence: DataFrame) -> DataFrame:
    """(type, canonical, name): every name of each node."""
    return evidence.select("type", "canonical", "name").distinct()


def provenance(evidence: DataFrame) -> DataFrame:
    """(id, doc_id): every document of each node."""
    return evidence.where("doc_id IS NOT NULL").select(node_id("type", "canonical").alias("id"), "doc_id").distinct()


def _properties(evidence: DataFrame) -> DataFrame:
    each = evidence.select("type", "canonical", "seq", F.explode("properties").alias("k", "v")).groupBy("type", "canonical", "k").agg(F.max_by("v", "seq").alias("v"))
    return each.groupBy("type", "canonical").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))


def nodes(evidence: DataFrame) -> DataFrame:
    """(id, type, canonical, name, geography, names, source_ids, trust, properties) from (type, canonical, name, doc_id, trust, geography, properties, seq).

    First seen wins for name and geography, trust is the largest, the last value of each property wins.
    """
    base = evidence.groupBy("type", "canonical").agg(
        F.min_by("name", "seq").alias("name"), F.min_by("geography", F.when(F.col("geography").isNotNull(), F.col("seq"))).alias("geography"),
        F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.collect_set("doc_id")).alias("source_ids"), F.max("trust").alias("trust"),
    )
    return base.join(_properties(evidence), ["type", "canonical"], "left").withColumn("id", node_id("type", "canonical"))


_VALUE = ("value_low", "value_high", "unit", "evidence")


def edge_table(evidence: DataFrame) -> DataFrame:
    """edges() with n_sources instead of the list of documents; summed up by document first."""
    key = ["src", "dst", "rel_type"]
    given = F.col("value_low").isNotNull() | F.col("evidence").isNotNull()
    by_doc = evidence.groupBy(*key, "doc_id").agg(F.max("trust").alias("trust"), F.max_by(F.struct(F.col("seq"), *_VALUE), F.when(given, F.col("seq"))).alias("v"))
    out = by_doc.groupBy(*key).agg(F.count("doc_id").alias("n_sources"), F.max("trust").alias("trust"), F.max_by("v", "v.seq").alias("v"))
    return out.select(*key, "n_sources", "trust", *[f"v.{c}" for c in _VALUE])


def edges(evidence: DataFrame) -> DataFrame:
    """One edge for each (src, dst, rel_type): all sources, largest trust, last value, unit and evidence that was given."""
    given = F.col("value_low").isNotNull() | F.col("evidence").isNotNull()
    last = F.max_by(F.struct(*_VALUE), F.when(given, F.col("seq")))
    out = evidence.groupBy("src", "dst", "rel_type").agg(F.array_sort(F.collect_set("doc_id")).alias("source_ids"), F.max("trust").alias("trust"), last.alias("v"))
    return out.select("src", "dst", "rel_type", "source_ids", "trust", *[f"v.{c}" for c in _VALUE])


def n_sources(df: DataFrame) -> Column:
    """How many documents a row of nodes or edges has, kept as a count or as a list."""
    return F.col("n_sources") if "n_sources" in df.columns else F.size("source_ids").cast("long")


def with_endpoints(node: DataFrame, edge: DataFrame) -> DataFrame:
    """node and a bare row (trust 1, geography Unknown) for each endpoint of edge that it lacks."""
    ends = edge.select(F.col("src").alias("id")).union(edge.select("dst")).distinct().join(node, "id", "left_anti")
    bare = ends.select("id", F.substring_index("id", ":", 1).alias("type"), F.expr("substring(id, instr(id, ':') + 1)").alias("canonical"), F.lit(1).alias("trust"), F.lit("Unknown").alias("geography"))
    return node.unionByName(bare.withColumn("name", F.col("canonical")), allowMissingColumns=True)


def document_evidence(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge evidence of documents (id, title, authors, trust, geography, path): a Publication, its Experts, described_in."""
    seq = F.struct(F.col("path").alias("path"), F.lit(0).alias("phase"), F.lit(0).alias("idx"), F.lit(0).alias("ord"))
    pub = docs.select(F.lit("Publication").alias("type"), F.concat(F.lit("doc:"), "id").alias("canonical"), F.col("title").alias("name"), F.col("id").alias("doc_id"), "trust", "geography", seq.alias("seq"))
    who = docs.select("id", "trust", "geography", "path", F.posexplode("authors").alias("ord", "author"))
    seq = F.struct(F.col("path").alias("path"), F.lit(0).alias("phase"), F.lit(1).alias("idx"), F.col("ord").alias("ord"))
    experts = who.select(F.lit("Expert").alias("type"), F.col("author").alias("canonical"), F.col("author").alias("name"), F.col("id").alias("doc_id"), "trust", "geography", seq.alias("seq"))
    edge = who.select(node_id(F.lit("Expert"), F.col("author")).alias("src"), F.concat(F.lit("Publication:doc:"), "id").alias("dst"), F.lit("described_in").alias("rel_type"), F.col("id").alias("doc_id"), "trust", seq.alias("seq"))
    return pub.unionByName(experts), edge


def with_types(related: DataFrame, found: DataFrame) -> DataFrame:
    """related with the types of both ends: its own, else that of a mention of the name in the document, else Process and Material."""
    kinds = found.groupBy("doc_id", "canonical").agg(F.min_by("type", F.struct("chunk_idx", "ord")).alias("kind"))
    out = related
    for end, default in (("src", "Process"), ("dst", "Material")):
        own = F.col(f"{end}_type") if f"{end}_type" in related.columns else F.lit(None).cast("string")
        out = out.join(kinds.select("doc_id", F.col("canonical").alias(end), F.col("kind").alias(f"_{end}")), ["doc_id", end], "left").withColumn(f"{end}_type", F.coalesce(own, f"_{end}", F.lit(default))).drop(f"_{end}")
    return out


def extraction_evidence(found: DataFrame, related: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge evidence of mentions and relations; every entity is described_in its document."""
    about = docs.select(F.col("id").alias("doc_id"), "path", "trust", "geography")
    m, r = found.join(about, "doc_id"), with_types(related, found).join(about, "doc_id")
    seq = F.struct(F.col("path").alias("path"), F.lit(1).alias("phase"), F.col("chunk_idx").alias("idx"), F.col("ord").alias("ord"))
    value = F.when(F.col("value_low").isNotNull(), F.create_map(F.lit("value"), F.col("value_low").cast("string"), F.lit("unit"), F.col("unit"))).otherwise(F.create_map().cast("map<string,string>"))
    node = m.select("type", "canonical", "name", "doc_id", "trust", "geography", value.alias("properties"), seq.alias("seq"))
    described = m.select(node_id("type", "canonical").alias("src"), F.concat(F.lit("Publication:doc:"), "doc_id").alias("dst"), F.lit("described_in").alias("rel_type"), "doc_id", "trust", seq.alias("seq"))
    edge = r.select(node_id("src_type", "src").alias("src"), node_id("dst_type", "dst").alias("dst"), "rel_type", "doc_id", "trust", "value_low", "value_high", "unit", "evidence", seq.alias("seq"))
    return node, edge.unionByName(described, allowMissingColumns=True)


def curated(rows: DataFrame, edits: DataFrame, key: str = "id") -> DataFrame:
    """rows after the latest edit (key, at, deleted, and the columns of rows) of each key."""
    latest = edits.groupBy(key).agg(F.max_by(F.struct(*[c for c in edits.columns if c != key]), "at").alias("e")).select(key, "e.*")
    kept = latest.where(~F.coalesce("deleted", F.lit(False))).select([c for c in rows.columns if c in latest.columns])
    return rows.join(latest.select(key), key, "left_anti").unionByName(kept, allowMissingColumns=True)


# --- queries ---


def entity(node: DataFrame, id: str) -> DataFrame:
    return node.where(F.col("id") == id)


def entity_named(node: DataFrame, type: str, name: str, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """The node of a type and a term, which is brought to its canonical form first."""
    return node.where((F.col("type") == type) & (F.col("canonical") == lexicon.canonical(name)))


def find_entities(node: DataFrame, type: str | None = None, name: str | None = None, canonical: str | None = None, limit: int | None = None) -> DataFrame:
    """Nodes of the type and canonical name whose name, canonical name or any other name holds ``name``."""
    out = node
    if type is not None:
        out = out.where(F.col("type") == type)
    if canonical is not None:
        out = out.where(F.col("canonical") == canonical)
    if name is not None:
        low = F.lit(name.lower())
        hit = F.contains(F.lower("name"), low) | F.contains(F.lower("canonical"), low)
        if "names" in node.columns:
            hit = hit | F.coalesce(F.exists("names", lambda n: F.contains(F.lower(n), low)), F.lit(False))
        out = out.where(hit)
    return out.orderBy("id").limit(limit) if limit else out


def neighbours(edge: DataFrame, id: str, depth: int = 2, limit: int | None = 50) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, distance) within depth, nearest first then by id, at most limit (None: all, in no order); and the edges among them.

    Each step joins the edges with the nodes that the step before reached; no ids pass through the driver.
    A node counts with its first step. Since cutting is by distance, what a cut node would have reached
    would be cut as well. Steps are kept while later ones use them (cached; computed again where lost).
    """
    both = edge.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(edge.select("dst", "src"))
    start = both.where(F.col("id") == id)
    reached = start.select("id").limit(1)
    found = reached.select("id", F.lit(0).alias("distance"))
    for d in range(1, depth + 1):
        reached = (start if d == 1 else both.join(reached, "id", "left_semi")).select(F.col("other").alias("id")).distinct()
        reached = reached.persist() if d < depth else reached
        found = found.union(reached.select("id", F.lit(d)))
    near = found.groupBy("id").agg(F.min("distance").alias("distance"))
    near = (near if limit is None else near.orderBy("distance", "id").limit(limit)).persist()
    ids = near.select("id")
    return near, edge.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")


def chain(edge: DataFrame, node: DataFrame, process: str, material: str | None = None) -> DataFrame:
    """Out-edges of a process with their targets."""
    out = edge.where(F.col("src") == f"Process:{process}").join(node.select(F.col("id").alias("dst"), F.col("type").alias("target_type"), F.col("canonical").alias("target")), "dst")
    out = out.where(F.contains(F.lower("target"), F.lit(material.lower()))) if material else out
    return out.select("target", "target_type", "rel_type", "value_low", "value_high", "unit", "trust", *[c for c in ("source_ids", "n_sources") if c in edge.columns])


def contradictions(evidence: DataFrame, threshold: float = 0.3, merged: bool = False) -> DataFrame:
    """(src, dst, low, high, n, lowest, highest, spread): parameters whose values differ by more than the share of the largest.

    Computed over evidence, one value a source; merged=True takes merged edges, one value an edge.
    lowest and highest are the rows of the extreme values (value, unit, source); entries() gives all.
    """
    rows = (edge_table(evidence).withColumn("doc_id", F.lit(None).cast("string")) if merged else evidence).where("rel_type = 'has_parameter' AND value_low IS NOT NULL")
    entry = F.struct(F.col("value_low").alias("value"), "unit", F.col("doc_id").alias("source"))
    got = rows.groupBy("src", "dst").agg(F.min("value_low").alias("low"), F.max("value_low").alias("high"), F.count(F.lit(1)).alias("n"), F.min(entry).alias("lowest"), F.max(entry).alias("highest"))
    spread = F.try_divide(F.col("high") - F.col("low"), F.col("high"))
    return got.where((F.col("n") >= 2) & (F.col("high") > 0)).withColumn("spread", spread).where(F.col("spread") > threshold)


def entries(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """(src, dst, value, unit, source): the values behind contradictions()."""
    rows = evidence.where("rel_type = 'has_parameter' AND value_low IS NOT NULL").select("src", "dst", F.col("value_low").alias("value"), "unit", F.col("doc_id").alias("source"))
    return rows.join(found.select("src", "dst"), ["src", "dst"], "left_semi")


def gaps(node: DataFrame, edge: DataFrame, most: int = 20, least_sources: int = 2, limit: int = 50) -> DataFrame:
    """Pairs of the first processes and materials, both well documented, that no uses_material edge joins."""
    first = lambda t, name: node.where(F.col("type") == t).orderBy(*(["seq"] if "seq" in node.columns else []), "id").limit(most).where(n_sources(node) >= least_sources).select(F.col("id").alias(name), n_sources(node).alias(f"{name}_sources"))
    pairs = first("Process", "process").join(F.broadcast(first("Material", "material")), F.lit(True))
    used = edge.where("rel_type = 'uses_material'").select(F.col("src").alias("process"), F.col("dst").alias("material"))
    return pairs.join(used, ["process", "material"], "left_anti").orderBy("process", "material").limit(limit)


def stats(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(kind, type, n): nodes and edges by type and in total (type null), in one pass over each."""
    of = lambda df, kind, col: df.rollup(col).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.col(col).alias("type"), "n")
    return of(node, "node", "type").union(of(edge, "edge", "rel_type"))


def query_facts(node: DataFrame, edge: DataFrame, query: str, per_node: int = 10, most: int = 20) -> DataFrame:
    """Lines on the out-edges of processes, then materials, that the query names."""
    named = node.where(F.col("type").isin("Process", "Material") & F.contains(F.lit(query.lower()), F.lower("canonical"))).select("id", "type", "canonical")
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("src").orderBy("rel_type", "dst"))
    out = edge.join(named, F.col("src") == F.col("id")).withColumn("k", rank).where(F.col("k") <= per_node)
    line = F.format_string("%s (%s) —%s→ %s [%d]", "canonical", "type", "rel_type", "dst", n_sources(edge))
    return out.orderBy(F.when(F.col("type") == "Process", 0).otherwise(1), "src", "k").limit(most).select(line.alias("line"))


def subgraph(edge: DataFrame, node: DataFrame, doc_ids: list[str], limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """The first edges that touch documents, and the nodes they name."""
    docs = [f"Publication:doc:{d}" for d in doc_ids]
    some = edge.where(F.col("src").isin(docs) | F.col("dst").isin(docs)).orderBy("src", "dst", "rel_type").limit(limit)
    ids = some.select(F.col("src").alias("id")).union(some.select("dst")).distinct()
    return node.join(ids, "id", "left_semi"), some


def incident(edge: DataFrame, id: str) -> DataFrame:
    return edge.where((F.col("src") == id) | (F.col("dst") == id))


def autocomplete(node: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """Nodes whose name holds the term; a term of one letter finds none."""
    return find_entities(node, name=term, limit=limit) if len(term) > 1 else node.limit(0)
