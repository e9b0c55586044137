"""Goldens of the library's operators, and its queries against DuckDB."""

import io
import math
import re
import zipfile
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skarn.functions import text as T
from skarn.operators import answer, chunking, extract, facts, graph, search
from skarn.plans.queries import ORACLES, QUERIES
from skarn.sources import files, store
from skarn.streaming import incremental


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_scalars(spark):
    lit = F.lit
    r = one(spark, T.language(lit("Это русский текст")), T.language(lit("This is English text")), T.language(lit("")), T.geography(lit("Норникель и Российская академия наук")), T.year(lit("опубликовано в 2023 году")), T.year(lit("текст")),
            T.normalize_term(lit("  Никель ")), T.normalize_term(lit(" Abc ")), T.trust_stars(lit(5)), T.trust_stars(lit(3)), T.doc_id(lit("/path/to/test.pdf")), T.doc_id(lit("a.pdf")), T.chunk_id(lit("d"), lit(7)))
    assert list(r) == ["ru", "en", "en", "Russia", 2023, None, "никель", "Abc", "★★★★★", "★★★☆☆", "01b0c5cbb5ba7693", "49b732e3fec4da30", "d_0007"]
    r = one(spark, T.title(lit("ISSN 1234-5678 journal\nA long enough title here\nx"), lit("f.pdf")), T.title(lit("short"), lit("dir/name.v1.pdf")), T.authors(lit("Иванов И.И., Петров П.\nSmith A")), T.confidence_label(lit(None).cast("double")), T.value_label(lit(20.0), lit(30.0), lit("mg_per_l")),
            T.compact_number(lit(12500)), T.category(lit("/x/Обзоры/a.pdf")), T.category(lit("/x/a.pdf"))["source_type"], T.trust(lit("patent")), T.file_slug(lit("Никель & Co"), lit("2024-01-02"), "md"))
    assert list(r)[:6] == ["A long enough title here", "name.v1", ["Иванов И.И.", "Петров П."], "средняя", "20–30 мг/л", "12.5 тыс."]
    assert tuple(r[6]) == ("review", "review") and list(r)[7:] == ["scientific_article", 4, "2024-01-02-никель-co.md"]
    T.register(spark)
    assert list(spark.sql("SELECT kg_normalize_term(' Ni '), kg_extract_year('in 1999'), kg_trust_stars(2), kg_tokenize('a Bc dé'), kg_detect_language('Это')").first()) == ["никель", 1999, "★★☆☆☆", ["bc"], "ru"]


def test_numbers_are_written_without_exponents(spark):
    shown = one(spark, *[T.value_label(F.lit(x), F.lit(x), F.lit("percent")) for x in (12345678.5, 1e9, 0.0001, 0.0, 7.25)], T.compact_number(F.lit(2.5e10)), T.compact_number(F.lit(-999.0)))
    assert [*shown] == ["12345678.5 %", "1000000000 %", "0.0001 %", "0 %", "7.25 %", "25000 млн", "-999"]


def test_chunks(spark):
    assert chunking.pieces("") == [] and chunking.pieces("x" * 50) == []
    text = "Sentence number one is here. " * 100
    got = chunking.pieces(text)
    assert all(50 < len(p) <= 1250 for p in got) and got[0].endswith(".") and text.strip().endswith(got[-1].strip())
    with pytest.raises(ValueError):
        chunking.pieces("x", 300, 200)
    df = spark.createDataFrame([("d", ["a" * 60, "b" * 60]), ("e", ["c" * 60])], "doc_id string, pages array<string>")
    assert sorted(tuple(r)[:4] for r in chunking.chunk_pages(df).collect()) == [("d_0000", "d", 0, 1), ("d_0001", "d", 1, 2), ("e_0000", "e", 0, None)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Содержание никеля составило 12.5%, выход концентрата 85%.", {("Material", "концентрат", None), ("Parameter", "выход", None), ("Parameter", "parameter_%", 12.5)}),
        ("Температура плавления составила 1200°C, давление 2.5 атм.", {("Parameter", "температура", None), ("Parameter", "давление", None)}),
        ("Nickel ore beneficiation using flotation cells.", {("Material", "никель", None), ("Material", "ore", None), ("Process", "обогащение", None), ("Process", "флотация", None), ("Equipment", "cell", None)}),
        ("Никель, никель, Ni, nickel, НИКЕЛЬ", {("Material", "никель", None)}),
        ("расход 5 видов", {("Parameter", "расход", None)}),
        ("", set()),
    ],
)
def test_mentions(spark, text, want):
    chunks = spark.createDataFrame([("c", "d", 0, text)], "id string, doc_id string, idx int, text string")
    assert {(r.type, r.canonical, r.value_low) for r in extract.mentions(chunks).collect()} == want


def test_relations_and_json(spark):
    chunks = spark.createDataFrame([("c", "d", 0, "Флотация: никель, 80 мг/л"), ("e", "d", 1, "флотация никель")], "id string, doc_id string, idx int, text string")
    rel = extract.relations(extract.mentions(chunks), chunks).collect()
    assert {(r.rel_type, r.dst, r.value_low) for r in rel} == {("uses_material", "никель", None), ("has_parameter", "parameter_мг/л", 80.0)}
    assert extract.json_from_reply('```json\n{"a": [1]}\n```') == {"a": [1]} and extract.json_from_reply("so: [1, 2].") == [1, 2] and extract.json_from_reply("no") == {}
    found = extract.model_mentions(chunks, lambda t: '{"entities": [{"name": "Nickel"}, {"name": "гипс"}]}', every=1)
    both = extract.with_model(extract.mentions(chunks), found)
    assert both.where("canonical = 'никель'").count() == 2 and both.where("canonical = 'гипс'").count() == 2


def test_graph(spark):
    rows = [("Material", "никель", "никель", "doc1", 3, None, {"a": "1"}, 1), ("Material", "никель", "nickel", "doc2", 5, "Russia", {"a": "2", "b": "3"}, 2)]
    ev = spark.createDataFrame(rows, "type string, canonical string, name string, doc_id string, trust int, geography string, properties map<string,string>, seq int")
    n = graph.nodes(ev).first()
    assert (n.id, n["name"], n.names, n.source_ids, n.trust, n.geography, n.properties) == ("Material:никель", "никель", ["nickel", "никель"], ["doc1", "doc2"], 5, "Russia", {"a": "2", "b": "3"})
    edge = spark.createDataFrame([("Material:руда", "Process:обогащение", "undergoes"), ("Process:обогащение", "Equipment:флотомашина", "uses_equipment")], "src string, dst string, rel_type string")
    near, between = graph.neighbours(edge, "Process:обогащение", 1)
    assert near.count() == 3 and between.count() == 2 and graph.neighbours(edge, "none")[0].count() == 0
    full = graph.with_endpoints(graph.nodes(ev), edge)
    assert full.count() == 4
    e = spark.createDataFrame([("Process:плавка", "Parameter:t", "has_parameter", "doc1", 1, 1200.0, 1200.0, "C", "", 1), ("Process:плавка", "Parameter:t", "has_parameter", "doc2", 1, 700.0, 700.0, "C", "", 2)], "src string, dst string, rel_type string, doc_id string, trust int, value_low double, value_high double, unit string, evidence string, seq int")
    c = graph.contradictions(e).first()
    assert (c.low, c.high) == (700.0, 1200.0) and math.isclose(c.spread, 500 / 1200) and graph.contradictions(e, merged=True).count() == 0
    two = spark.createDataFrame([("Process:обжиг", "Process", ["a", "b"]), ("Material:никель", "Material", ["a", "b"])], "id string, type string, source_ids array<string>")
    assert [tuple(r)[:2] for r in graph.gaps(two, edge).collect()] == [("Process:обжиг", "Material:никель")]


def test_incremental_build_equals_full_build(spark):
    ev = spark.range(200).select(F.lit("M").alias("type"), (F.col("id") % 7).cast("string").alias("canonical"), F.concat(F.lit("n"), F.col("id") % 3).alias("name"), F.col("id").cast("string").alias("doc_id"), (F.col("id") % 5).cast("int").alias("trust"), F.lit("x").alias("geography"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("properties"), F.col("id").alias("seq"))
    parts = ev.where("seq < 80").unionByName(ev.where("seq >= 80").repartition(5))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(graph.nodes(ev)) == key(graph.nodes(parts))


def test_search(spark):
    docs = spark.createDataFrame([("a", "никель кобальт обогащение руда"), ("b", "температура давление плавление")], "id string, text string")
    for q, want in (("никель обогащение", 1.302558460112649), ("никель никель обогащение", 1.9538376901689736)):
        (hit,) = search.bm25(docs, q).collect()
        assert hit.id == "a" and math.isclose(hit.score, want)
        posted = search.postings(docs)
        (same,) = search.bm25_indexed(posted, search.term_stats(posted, 2), 3.5, q).collect()
        assert math.isclose(same.score, want)
    assert search.bm25(docs, "zzz").count() == 0 and search.bm25(docs, "").count() == 0
    chunks = docs.withColumn("doc_id", F.col("id"))
    meta = spark.createDataFrame([("a", 2024, "Russia"), ("b", None, "Foreign")], "id string, year int, geography string")
    vectors = docs.select("id", search.encode(F.col("text")).alias("embedding"))
    q = [float(x) for x in search.hashed_encoder()(["никель руда"])[0]]
    assert [r.chunk_id for r in search.search(chunks, meta, "никель", vectors=vectors, query_vector=q).collect()][0] == "a"
    assert search.search(chunks, meta, "никель", filters={"geography": ["Foreign"]}).count() == 0
    assert [r.chunk_id for r in search.search(chunks, meta, "температура", filters={"year_from": 2020}).collect()] == ["b"]
    assert [r.id for r in search.listed(meta, year_from=2020)[0].collect()] == ["a"]


def test_questions():
    p = answer.parse_query("сульфатов <200 мг/л")
    assert p["numeric_conditions"] == [{"parameter": "сульфатов", "operator": "<", "value": 200.0, "unit": "мг/л"}]
    assert [c["operator"] for c in answer.parse_query("концентрация от 100 до 200 мг/л")["numeric_conditions"]] == ["от"]
    assert answer.parse_query("сульфаты 2000 мг/л")["filters"] == {"year_from": 2000, "year_to": 2000}
    assert answer.parse_query("за последние 5 лет", 2024)["filters"] == {"year_from": 2019, "year_to": 2024}
    assert answer.retrying([lambda p: 1 / 0, lambda p: "ok"])("x") == "ok"


def test_answer(spark):
    docs = spark.createDataFrame([("a", 2024, "Russia", "T")], "id string, year int, geography string, title string")
    chunks = spark.createDataFrame([("a_0000", "a", "никель флотация руда")], "id string, doc_id string, text string")
    ev = spark.createDataFrame([("Process:флотация", "Material:никель", "uses_material", "a", 1, None, None, None, None, 1)], "src string, dst string, rel_type string, doc_id string, trust int, value_low double, value_high double, unit string, evidence string, seq int")
    edge = graph.edges(ev)
    node = graph.with_endpoints(spark.createDataFrame([], "id string, type string, canonical string, name string, trust int, geography string, source_ids array<string>"), edge)
    got = answer.answer("флотация никель", chunks, docs, node, edge, ev)
    assert len(got["sources"]) == 1 and "Источников: 1" in got["answer"] and len(got["graph_facts"]) == 1
    assert answer.answer("флотация", chunks, docs, node, edge, ev, ask=lambda p: "да")["answer"] == "да"


def test_facts(spark):
    f = spark.createDataFrame([("Ni", "m", 10.0, "a", 2020, 0.9, None), ("Ni", "m", 10.5, "b", None, None, "secret"), ("Ni", "m", 20.0, "c", 2010, 0.3, "public")], "canon string, metric string, value_low double, doc_id string, year int, confidence double, sensitivity string").withColumns({"phase": F.lit(None).cast("string"), "unit": F.lit("x"), "geo": F.lit(None).cast("string"), "value_high": F.col("value_low")})
    assert {(r.doc_a, r.doc_b): r.rel for r in facts.verify(f).collect()} == {("a", "b"): "VALIDATED_BY", ("a", "c"): "CONTRADICTS", ("b", "c"): "CONTRADICTS"}
    assert f.where(facts.passes({"min_confidence": 0.5, "year_from": 2015, "geo": ["WORLD"], "material": ["ni"]})).count() == 2
    assert f.where(facts.visible("external_partner")).count() == 2 and facts.describe({}) is None and "с года: 2015" in facts.describe({"year_from": 2015})
    assert "1. Ni · m: 10" in store.markdown(f.withColumn("quote", F.lit("q")), "T", "A").first().text and '"@type":"Dataset"' in store.json_ld(f, "T").first().text and store.pdf("x").startswith(b"%PDF")
    docs = spark.createDataFrame([("a", "RU", ["x"]), ("b", "WORLD", ["x", "y"])], "doc_id string, geo string, domains array<string>")
    s = facts.summary(docs, f, spark.range(3), spark.range(2))
    assert (s["docs"], s["ru"], s["facts"], s["domains"], s["fact_coverage"], s["experts"]) == (2, 1, 3, 2, 1.0, 3)


def test_reports(spark):
    cols = "canon string, phase string, metric string, value_low double, value_high double, unit string, quote string, doc_id string, year int"
    rows = [
        ("Сульфаты", None, "содержание", 200.0, 300.0, "мг/л", None, "a", 2020), ("сульфат", None, None, 250.0, 301.0, "мг/л", None, "b", 2020), ("sulfate", None, None, 2.0, 2.0, "g_per_l", None, "c", None), ("sulfate", None, None, None, None, "mg_per_l", None, "d", None),
        ("никель", "католит", None, 70.0, None, "г/л", None, "e", 1999), ("золото", "шлак", None, 2.77, 2.77, "g_t", None, "f", None), ("Платина", "штейн", None, 1.0, 1.0, "g_t", None, "g", 2019), ("серебро", None, None, 1.0, 1.0, "g_t", None, "h", 2018), (None, None, None, None, None, None, None, None, None),
    ]
    f = spark.createDataFrame(rows, cols)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(facts.desalination(f)) == ["a"] and ids(facts.desalination(f, 301)) == ["a", "b"]
    assert ids(facts.catholyte(f)) == ["e"] and ids(facts.precious_metals(f, 2024)) == ["f", "g"]
    assert facts.reference_rows(f, []).count() == 0 and facts.catholyte(f.limit(0)).count() == 0


def test_chunks_as_a_table_function(spark):
    chunking.register(spark)
    text = "A sentence of some words. " * 120
    rows = spark.sql(f"SELECT * FROM kg_chunk('{text}', 1200, 200)")
    assert [tuple(r) for r in rows.collect()] == list(enumerate(chunking.pieces(text)))
    assert spark.sql("SELECT * FROM kg_chunk(CAST(NULL AS STRING))").collect() == []


def test_files(spark, tmp_path):
    body = "Никель содержится в руде 2021 года. " * 10
    (tmp_path / "Обзоры").mkdir()
    (tmp_path / "Обзоры" / "a.txt").write_text(body)
    (tmp_path / "b.md").write_text(body)
    (tmp_path / "short.txt").write_text("x")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body><w:p><w:t>{body}</w:t></w:p><w:tbl><w:tr><w:tc><w:p><w:t>k</w:t></w:p></w:tc><w:tc><w:p><w:t>v</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "c.docx").write_bytes(raw.getvalue())
    docs = files.ingest(spark, str(tmp_path))
    rows = {r.filename: r for r in docs.collect()}
    assert set(rows) == {"a.txt", "c.docx"} and rows["a.txt"].category == "review" and rows["a.txt"].year == 2021 and rows["c.docx"].pages[0].endswith("k | v")
    assert files.ingest(spark, str(tmp_path), existing=docs).count() == 0
    assert files.scan(spark, str(tmp_path)).select(files.sniffed("content").alias("k")).where("k = 'zip'").count() == 1
    store.save(f"{tmp_path}/out", documents=docs)
    assert store.load(spark, f"{tmp_path}/out", "documents")["documents"].count() == 2


def test_streams(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    incremental.each_batch(stream, lambda b: b.select("event_id"), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == e.count()
    q = incremental.tumbling(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"), late="1 hour").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == e.count()
    q = incremental.once_each(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"), "event_id").writeStream.format("memory").queryName("o").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("o").count() == e.select("event_id").distinct().count()


def value(v):
    if v is None or v != v:
        return None
    return round(float(v), 5) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_equal_their_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    rows = [tuple(map(value, r)) for r in got.select(*[F.col(f"`{c}`") for c in sorted(got.columns)]).collect()]
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        names = [d[0] for d in cur.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        want = [tuple(value(r[k]) for k in order) for r in cur.fetchall()]
        assert sorted(names) == sorted(got.columns)
        assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_a_neighbourhood_of_any_size_is_whole(spark, sf, tmp_path):
    for name in ("nation", "region", "supplier"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.range(100_100).select(F.col("id").alias("c_custkey"), F.lit("c").alias("c_name"), F.when(F.col("id") >= 50, 5).otherwise(1).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for name in ("nation", "region", "supplier", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["neighbors_bfs"](spark, str(tmp_path)).collect()]
    assert len(got) > 100_050 and sorted(got) == sorted(con.execute(ORACLES["neighbors_bfs"]).fetchall())
    edge = spark.range(60).select(F.lit("a").alias("src"), F.concat(F.lit("b"), F.col("id")).alias("dst"))
    near, between = graph.neighbours(edge, "a", 1, limit=None)
    assert near.count() == 61 and between.count() == 60 and graph.neighbours(edge, "a", 1)[0].count() == 50 and graph.neighbours(edge, "c", limit=None)[0].count() == 0


def test_every_term_is_in_the_whole_index(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    df = Counter(w for x in texts for w in {w for w in re.findall("[а-яёa-z0-9]+", (x or "").lower()) if len(w) > 1})
    got = {r.term: (r.df, r.idf) for r in QUERIES["term_index_all"](spark, sf).collect()}
    assert min(df.values()) < 5 and {w: n for w, (n, _) in got.items()} == dict(df)
    assert all(abs(got[w][1] - math.log((len(texts) - n + 0.5) / (n + 0.5) + 1)) < 1e-6 for w, n in df.items())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
