"""Keeping the graph and the index as Parquet, and exports of answers."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.text import plain_number

TABLES = ("documents", "chunks", "nodes", "edges", "edge_evidence", "node_evidence", "postings", "term_stats", "corpus_stats", "embeddings", "facts")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share (spark.checkpoint.dir; on one machine also a local folder)."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="skarn-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any storage that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with n, counted from 1 in the given order, which should leave no ties. No task or driver holds all rows.

    Rows are dealt out by ranges of the order and written once; the driver gets one count for each part.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, "numbered")
    df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    part = F.shiftright("_at", 33)
    before, total = {}, 0
    for r in dealt.groupBy(part.alias("p")).count().orderBy("p").collect():
        before[r.p], total = total, total + r["count"]
    first = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map().cast("map<bigint,bigint>")
    return dealt.withColumn("n", (first[part] + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("long")).drop("_at")


def save(path: str, **tables: DataFrame) -> None:
    """Write tables; postings are ordered by term so that a query's terms prune row groups."""
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"unknown table {name}")
        if name == "postings":
            df = df.repartitionByRange("term").sortWithinPartitions("term", "id")
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def node_link(node: DataFrame, edge: DataFrame, most: int = 1_000_000) -> str:
    """Node-link JSON of a graph that is served from one file; one of more than ``most`` nodes and edges is refused (use save())."""
    if (n := node.count() + edge.count()) > most:
        raise ValueError(f"{n} nodes and edges are too many for one JSON text")
    rows = lambda df: [{k: v for k, v in r.asDict(True).items() if v is not None} for r in df.collect()]
    links = [r | {"source": r.pop("src"), "target": r.pop("dst")} for r in rows(edge.orderBy("src", "dst", "rel_type"))]
    return json.dumps({"directed": True, "multigraph": True, "graph": {}, "nodes": rows(node.orderBy("id")), "links": links}, ensure_ascii=False, indent=2)


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a node-link JSON file, parsed by Spark."""
    df = spark.read.option("multiLine", "true").json(path)
    return df.select(F.inline("nodes")), df.select(F.inline("links")).withColumnsRenamed({"source": "src", "target": "dst"})


def _shown(facts: DataFrame) -> Column:
    value = F.when(F.col("value_high").isNull() | (F.col("value_low") == F.col("value_high")), plain_number(F.col("value_low"))).otherwise(F.concat(plain_number(F.col("value_low")), F.lit("–"), plain_number(F.col("value_high"))))
    return F.concat(F.col("canon"), F.lit(" · "), F.coalesce("metric", F.lit("")), F.lit(": "), F.coalesce(value, F.lit("")), F.lit(" · "), F.coalesce("quote", F.lit("")))


def _claim() -> Column:
    return F.struct(F.lit("Claim").alias("@type"), F.col("canon").alias("about"), F.col("metric").alias("name"), F.array("value_low", "value_high").alias("value"), F.col("unit").alias("unitText"), F.col("doc_id").alias("citation"))


def markdown_lines(facts: DataFrame) -> DataFrame:
    """(n, text): one numbered line a fact, in the order of doc_id, canon and the line itself. For any number of facts."""
    return numbered(facts.select("doc_id", "canon", _shown(facts).alias("line")), "doc_id", "canon", "line").select("n", F.concat(F.col("n").cast("string"), F.lit(". "), F.col("line")).alias("text"))


def json_ld_claims(facts: DataFrame) -> DataFrame:
    """(text): one claim a fact as JSON, a line of JSON-LD each. For any number of facts."""
    return facts.select(F.to_json(_claim()).alias("text"))


def markdown(facts: DataFrame, title: str, answer: str) -> DataFrame:
    """(text): heading, answer and numbered facts of an answer, in the order of doc_id and canon. All in one text: see markdown_lines()."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "canon", _shown(facts).alias("line")))), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x.line))
    return facts.agg(F.concat_ws("\n", F.lit(f"# {title}"), F.lit(""), F.lit(answer), F.lit(""), F.array_join(lines, "\n")).alias("text"))


def json_ld(facts: DataFrame, title: str) -> DataFrame:
    """(text): a Dataset whose parts are the claims of an answer, with value [low, high] and citation. All in one text: see json_ld_claims()."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "canon", _claim().alias("c")))), lambda x: x.c)
    return facts.agg(F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Dataset").alias("@type"), F.lit(title).alias("name"), parts.alias("hasPart"))).alias("text"))


#: Codes above 191 hold the Cyrillic letters, as in the one-byte code page 1251; two more lie below.
_GLYPHS = "168 /afii10023 184 /afii10071 192 " + " ".join(f"/afii{k}" for k in (*range(10017, 10023), *range(10024, 10050), *range(10065, 10071), *range(10072, 10098)))
_LINES = 60


def pdf(text: str, width: int = 95) -> bytes:
    """A plain PDF of a whole text, Latin and Cyrillic: lines are broken at ``width`` characters, pages at 60 lines."""
    flat = [x[k : k + width] for x in text.split("\n") for k in range(0, max(1, len(x)), width)]
    coded = [x.encode("cp1251", "replace").replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)") for x in flat]
    sheets = [coded[k : k + _LINES] for k in range(0, len(coded), _LINES)]
    font = 3 + 2 * len(sheets)
    kids = b" ".join(b"%d 0 R" % (3 + 2 * k) for k in range(len(sheets)))
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(sheets))]
    for k, lines in enumerate(sheets):
        stream = b"BT /F1 10 Tf 40 800 Td 12 TL " + b" ".join(b"(" + x + b") Tj T*" for x in lines) + b" ET"
        parts.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents %d 0 R /Resources << /Font << /F1 %d 0 R >> >> >>" % (4 + 2 * k, font))
        parts.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream))
    parts.append(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /Type /Encoding /BaseEncoding /WinAnsiEncoding /Differences [%s] >> >>" % _GLYPHS.encode())
    out, at = bytearray(b"%PDF-1.4\n"), []
    for k, body in enumerate(parts, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    table = b"".join(b"%010d 00000 n \n" % a for a in at)
    return bytes(out) + b"xref\n0 %d\n0000000000 65535 f \n%strailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(parts) + 1, table, len(parts) + 1, len(out))
