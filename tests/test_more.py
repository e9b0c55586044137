"""Operators against plain code: numbers, graph tables, verification, sources, exports, clients."""

import io
import json
import random
import re
import time
import zipfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skarn.lexicon import DEFAULT, Lexicon
from skarn.operators import answer, chunking, extract, facts, graph, search
from skarn.sources import files, store

EDGE = "src string, dst string, rel_type string, doc_id string, trust int, value_low double, value_high double, unit string, evidence string, seq int"


def plain_values(text, lexicon):
    """(name, low, high, unit) by a plain scan of the whole text."""
    number, units = r"([0-9]+(?:[.,][0-9]+)?)", "|".join(re.escape(u) for u in sorted(lexicon.units, key=len, reverse=True))
    for m in re.finditer(rf"(?i)(?:<=|>=|<|>|≥|≤|≈|~)?\s*{number}\s*(?:[-–—]\s*{number}\s*)?({units})", text or ""):
        low, high = (float(x.replace(",", ".")) if x else None for x in m.group(1, 2))
        before = text[max(0, m.start() - 50) : m.start()].lower()
        name = next((lexicon.canonical(p) for p in lexicon.keywords["Parameter"] if p in before), f"parameter_{m[3]}")
        yield name, low, low if high is None else high, m[3]


def test_values_against_a_plain_scan(spark):
    rnd = random.Random(1)
    pieces = ["температура", "Давление ", "12", "3,5", "0.25", " - ", "–", "%", "мг/л", " МГ/Л", "°C", "в", "x" * 30, " ", "\n", "≤", ">=", "ток", "ph", "руб/т", ".", ",", "атм"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 60))) for _ in range(400)] + [None, "", "5%" * 200, "Температура 1200°C, давление 2.5 атм, pH 7", "сульфаты 200–300 мг/л", "расход 5 видов"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", extract.numeric_values(F.col("text")).alias("v"))
    for r in df.collect():
        want = list(plain_values(texts[r.k], DEFAULT))
        assert [(v.canonical, v.value_low, v.value_high, v.unit) for v in r.v] == want, texts[r.k]
        assert [v.ord for v in r.v] == [100_000 + i for i in range(len(want))]
    assert "Python" not in df._jdf.queryExecution().toString()
    no_names = Lexicon(keywords={"Material": ["ore"]}, synonyms={}, units=["%"])
    assert spark.range(1).select(extract.numeric_values(F.lit("3 % ore"), no_names)[0]["name"]).first()[0] == "parameter_%"


def test_pages_of_rows_that_share_an_id_stay_apart(spark):
    rows = [("d", ["a" * 60, "b" * 3000]), ("d", ["c" * 60]), ("e", None), ("f", []), ("g", [None, "g" * 51])]
    got = chunking.chunk_pages(spark.createDataFrame(rows, "doc_id string, pages array<string>"))
    assert sorted((r.id, r.page or 0, len(r.text)) for r in got.collect()) == [("d_0000", 0, 60), ("d_0000", 1, 60), *[(f"d_000{k + 1}", 2, len(p)) for k, p in enumerate(chunking.pieces("b" * 3000))], ("g_0000", 2, 51)]
    assert "Exchange" not in got._jdf.queryExecution().toString()


def test_tables_say_what_lists_say(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("AB"), str(rnd.randint(0, 5)), f"n{rnd.randint(0, 3)}", rnd.choice(["a", "b", "c", None]), rnd.randint(1, 5), rnd.choice([None, "x", "y"]), {rnd.choice("pq"): str(k)}, k) for k in range(200)]
    ev = spark.createDataFrame(rows, "type string, canonical string, name string, doc_id string, trust int, geography string, properties map<string,string>, seq int")
    lists = {r.id: r for r in graph.nodes(ev).collect()}
    table = {r.id: r for r in graph.node_table(ev).collect()}
    where = defaultdict(set)
    for r in graph.provenance(ev).collect():
        where[r.id].add(r.doc_id)
    assert lists.keys() == table.keys()
    for k, r in lists.items():
        t = table[k]
        assert (r["name"], r.geography, r.trust, r.properties, len(r.names), len(r.source_ids)) == (t["name"], t.geography, t.trust, t.properties, t.n_names, t.n_sources) and set(r.source_ids) == where[k]
    rows = [(f"s{rnd.randint(0, 2)}", "d", rnd.choice(["r", "has_parameter"]), rnd.choice(["a", "b", None]), rnd.randint(1, 5), rnd.choice([None, 1.0 * k]), None, "u", rnd.choice([None, "e"]), k) for k in range(100)]
    ev = spark.createDataFrame(rows, EDGE)
    lists, table = ({(r.src, r.rel_type): r for r in f(ev).collect()} for f in (graph.edges, graph.edge_table))
    assert all((r.trust, len(r.source_ids), r.value_low, r.unit, r.evidence) == (t.trust, t.n_sources, t.value_low, t.unit, t.evidence) for k, r in lists.items() for t in [table[k]])
    found = graph.contradictions(ev)
    one = found.first()
    values = sorted(r.value for r in graph.entries(found, ev).where(F.col("src") == one.src).collect())
    assert (one.low, one.high, one.n, one.lowest.value, one.highest.value) == (values[0], values[-1], len(values), values[0], values[-1])


def test_neighbours_against_plain_search(spark):
    rnd = random.Random(3)
    pairs = sorted({(f"n{rnd.randint(0, 60):02}", f"n{rnd.randint(0, 60):02}") for _ in range(90)})
    edge = spark.createDataFrame([(a, b, "r") for a, b in pairs], "src string, dst string, rel_type string")
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    for start, depth, limit in (("n00", 1, 50), ("n05", 2, 7), ("n07", 4, 1000), ("none", 2, 10)):
        distance = {start: 0} if near[start] else {}
        for d in range(1, depth + 1):
            for x in [x for x, k in distance.items() if k == d - 1]:
                for y in near[x]:
                    distance.setdefault(y, d)
        kept = dict(sorted(distance.items(), key=lambda x: (x[1], x[0]))[:limit])
        nodes, edges = graph.neighbours(edge, start, depth, limit)
        assert {r.id: r.distance for r in nodes.collect()} == kept
        assert {(r.src, r.dst) for r in edges.collect()} == {(a, b) for a, b in pairs if a in kept and b in kept}


def test_verification_by_classes_says_what_pairs_say(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("mn"), "c", None, rnd.choice(["u", None]), f"d{rnd.randint(0, 6)}", rnd.choice([10.0, 10.5, 11.0, 12.0, 13.5, 0.0, -4.0, None])) for _ in range(120)]
    f = spark.createDataFrame(rows, "metric string, canon string, phase string, unit string, doc_id string, value_low double")
    pairs = facts.verify(f).collect()
    count = defaultdict(int)
    for r in pairs:
        count[r.rel] += 1
    assert {r.rel: r.n for r in facts.verify_counts(f).collect()} == dict(count) and len(count) == 2
    key = lambda r: (r.metric, r.canon, r.unit, r.rel, *sorted((r.value_a, r.value_b)))
    classes = facts.verify_classes(f).collect()
    assert {key(r) for r in classes} == {key(r) for r in pairs} and len(classes) == len({key(r) for r in classes})
    linked = {(key(r), *sorted((r.doc_a, r.doc_b))) for r in pairs}
    assert all((key(r), *sorted((r.doc_a, r.doc_b))) in linked for r in classes)
    docs = spark.createDataFrame([(f"d{k}", [None, "RU", "WORLD"][k % 3]) for k in range(7)], "doc_id string, geo string")
    kinds = {(r.doc_a, r.doc_b): r.kind for r in facts.with_kind(facts.verify_classes(f), docs).collect()}
    assert {k for (a, b), k in kinds.items() if {int(a[1]) % 3, int(b[1]) % 3} == {1, 2}} == {"ru_vs_world"}
    assert facts.of_kind(facts.with_kind(facts.verify_classes(f), docs), "method_vs_method").where("kind <> 'method_vs_method'").count() == 0


def test_questions_of_a_table_are_read_like_single_ones(spark):
    asked = ["сульфатов <200 мг/л", "концентрация от 100 до 200 мг/л", "Сравнить российский и зарубежный опыт за последние 5 лет", "нет данных 2015, 2019 или 1999", "эксперты в России: pH не менее 2,5", "", "прошлые 3 лет и 2020 год: выход >= 5 %"]
    rows = answer.parsed(spark.createDataFrame([(q,) for q in asked], "query string"), 2024).collect()
    for r in rows:
        p = answer.parse_query(r.query, 2024)
        got = {k: v for k, v in (("geography", r.geography), ("year_from", r.year_from), ("year_to", r.year_to)) if v is not None}
        assert (r.intent, got, [c.asDict() for c in r.conditions]) == (p["intent"], p["filters"], p["numeric_conditions"]), r.query


def test_search_falls_back_to_text(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "никель кобальт"), ("b", "медь")], "id string, text string")
    chunks = docs.withColumn("doc_id", F.col("id"))
    vectors = search.add_vectors(spark.createDataFrame([("b", [0.0] * 312)], "id string, embedding array<float>"), docs)
    assert {r.id: len(r.embedding) for r in vectors.collect()} == {"a": 312, "b": 312} and max(vectors.where("id = 'b'").first().embedding) == 0
    q = [float(x) for x in search.hashed_encoder()(["никель"])[0]]
    both = search.search(chunks, docs.select("id"), "никель", vectors=vectors, query_vector=q).collect()
    late = search.search(chunks, docs.select("id"), "никель", vectors=vectors, query_vector=q, seconds=0.0).collect()
    alone = search.search(chunks, docs.select("id"), "никель").collect()
    assert late == alone and both != alone
    assert search.within(0.05, lambda: time.sleep(1), "late") == "late" and search.within(5, lambda: 1) == 1 and search.within(5, lambda: 1 / 0) is None and search.within(None, lambda: 2) == 2
    posted = sorted((r.term, r.id, r.tf, r.dl) for r in search.postings(spark.createDataFrame([("x", "b a b  bb Ca ca"), ("y", "")], "id string, text string").replace("b a b", "bb aa bb")).collect())
    assert posted == [("bb", "x", 1, 3), ("ca", "x", 2, 3)]


def test_clients(monkeypatch):
    slept, calls = [], []
    monkeypatch.setattr(answer.time, "sleep", slept.append)

    def bad(prompt):
        calls.append(prompt)
        raise OSError

    assert answer.retrying([bad, lambda p: "ok"], tries=2)("x") == "ok" and calls == ["x", "x"] and slept == [1.0, 1.0]
    with pytest.raises(RuntimeError):
        answer.retrying([bad], tries=1)("x")
    assert answer.in_json(bad, lambda p: 'so ```json\n{"a": 1}\n```')("x") == {"a": 1} and answer.in_json(lambda p: "[1]", bad)("x") == [1]


def test_model_relations_are_appended(spark):
    chunks = spark.createDataFrame([("c", "d", 0, "флотация никель"), ("e", "d", 1, "x"), ("f", "d", 2, "y")], "id string, doc_id string, idx int, text string")
    seen = []

    def ask(text):
        if "x" == text[-1]:
            raise OSError
        return json.dumps({"entities": [{"name": "Nickel", "type": "Material"}, {"name": "гипс"}, {"name": ""}], "relations": [{"source": "флотация", "target": "Nickel", "type": "purifies"}, {"source": "sth", "target": "else"}, {"source": "", "target": "q"}]})

    found, related = extract.extracted(chunks, ask=ask, every=1)
    assert seen == [] and {(r.chunk_id, r.canonical) for r in found.collect()} == {("c", "никель"), ("c", "флотация"), ("c", "гипс"), ("f", "никель"), ("f", "гипс")}
    rows = {(r.chunk_idx, r.src, r.src_type, r.dst, r.dst_type, r.rel_type) for r in related.collect()}
    assert {(0, "флотация", "Process", "никель", "Material", "uses_material"), (0, "флотация", "Process", "никель", "Material", "purifies"), (2, "sth", "Process", "else", "Material", "related_to")} <= rows
    assert "JSON" in extract.prompt("x" * 9000) and len(extract.prompt("x" * 9000)) < 4000
    typed = graph.with_types(spark.createDataFrame([("d", "никель", "zzz")], "doc_id string, src string, dst string"), found).first()
    assert (typed.src_type, typed.dst_type) == ("Material", "Material")
    assert graph.entity_named(spark.createDataFrame([("Material:никель", "Material", "никель")], "id string, type string, canonical string"), "Material", " Nickel ").count() == 1


def test_reviews(spark):
    f = spark.createDataFrame([("a", "флотация", 2020, 10.0), ("b", "флотация", 2020, 10.5), ("a", "обжиг", None, 1.0), ("c", "обжиг", None, 9.0)], "doc_id string, method string, year int, value_low double")
    docs = spark.createDataFrame([("a", "RU", "Title A"), ("b", "RU", None), ("c", "RU", "Title C")], "doc_id string, geo string, title string")
    text = answer.review_text("q", f, docs)
    assert "флотация, 2020, RU: 2, согласие [1][2]" in text and "обжиг, —, RU: 2, разногласие [1][3]" in text and text.endswith("1. Title A\n2. b\n3. Title C")
    assert "не найдено" in answer.review_text("q", f.limit(0), docs)
    seen = answer.assemble(f.withColumns({"canon": F.col("method"), "sensitivity": F.lit(None).cast("string"), "confidence": F.lit(0.9), "geo": F.lit("RU")}), spark.createDataFrame([("E", ["b"])], "name string, doc_ids array<string>"), "admin", [], {"year_from": 2015, "material": ["флот"]})
    assert seen["facts"].count() == 2 and seen["experts"].count() == 1 and [r.canon for r in seen["adjacent"].collect()] == ["флотация"]


def test_sources(spark, tmp_path):
    def packed(**parts):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for name, body in parts.items():
                z.writestr(name, body)
        return raw.getvalue()

    rows = "".join(f'<row><c t="s"><v>{k % 2}</v></c><c><v>{k}</v></c></row>' for k in range(600))
    sheet = packed(**{"xl/workbook.xml": '<w><sheets><sheet name="First"/></sheets></w>', "xl/sharedStrings.xml": "<s><si><t>a</t></si><si><t>b</t></si></s>", "xl/worksheets/sheet1.xml": f"<w><sheetData>{rows}</sheetData></w>"})
    (page,) = files.parse_xlsx(sheet)
    assert page.split("\n")[:3] == ["Sheet: First", "a | 0", "b | 1"] and len(page.split("\n")) == 501 and len(files.parse_xlsx(sheet, None)[0].split("\n")) == 601
    slides = packed(**{f"ppt/slides/slide{k}.xml": f"<s><p><t>text</t><t> {k}</t></p><p><t> </t></p></s>" for k in (2, 10, 1)})
    assert files.parse_pptx(slides) == ["text 1", "text 2", "text 10"]
    for k in range(12):
        (tmp_path / f"f{k:02}.txt").write_text("x" * (k + 1))
    (tmp_path / "a.exe").write_text("x")
    listed = spark.read.format("binaryFile").load(str(tmp_path))
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in files.upload_errors(listed, most_bytes=5, most_files=10).collect()}
    assert errors == {"a.exe": "extension", **{f"f{k:02}.txt": "size" if k >= 5 else None for k in range(12)}}
    assert files.upload_errors(listed, most_files=3).where("error = 'count'").count() == 10
    steps = spark.createDataFrame([("p", "upload", 1), ("p", "normalization", 2), ("q", "other", 1)], "path string, stage string, at int")
    assert [(r.path, r.stage, r.done) for r in files.upload_progress(steps).collect()] == [("p", "normalization", 0.6)]
    parts = spark.createDataFrame([("x.zip.002", b"cd"), ("x.zip.001", b"ab"), ("y.zip.002", b"zz"), ("z.zip.001", b"longer"), ("n.txt", b"")], "path string, content binary")
    got = {r.archive: (r.parts, r.content and bytes(r.content)) for r in files.joined_parts(parts, most_bytes=5).collect()}
    assert got == {"x.zip": (2, b"abcd"), "y.zip": (1, None), "z.zip": (1, None)}


def test_graph_file_and_exports(spark, tmp_path):
    node = spark.createDataFrame([("a", "A", ["x"]), ("b", "B", [])], "id string, type string, source_ids array<string>")
    edge = spark.createDataFrame([("a", "b", "r", 2)], "src string, dst string, rel_type string, trust int")
    (tmp_path / "g.json").write_text(store.node_link(node, edge))
    back = store.read_node_link(spark, f"{tmp_path}/g.json")
    assert {r.id for r in back[0].collect()} == {"a", "b"} and [(r.src, r.dst, r.rel_type, r.trust) for r in back[1].collect()] == [("a", "b", "r", 2)]
    with pytest.raises(ValueError):
        store.node_link(node, edge, most=2)
    f = spark.range(0, 5000, 1, 7).select((F.col("id") % 100).cast("string").alias("doc_id"), F.concat(F.lit("c"), F.col("id")).alias("canon"), F.lit("m").alias("metric"), F.col("id").cast("double").alias("value_low"), F.lit(None).cast("double").alias("value_high"), F.lit("u").alias("unit"), F.lit("q").alias("quote"))
    lines = {r.n: r.text for r in store.markdown_lines(f).collect()}
    want = sorted((str(k % 100), f"c{k}") for k in range(5000))
    assert sorted(lines) == list(range(1, 5001)) and all(lines[n].startswith(f"{n}. {c} · m: ") for n, (_, c) in enumerate(want, 1))
    assert store.markdown_lines(f.limit(0)).count() == 0 and store.json_ld_claims(f).count() == 5000
    text = "\n".join([f"строка (line) {k}" for k in range(150)] + ["w" * 200])
    raw = store.pdf(text)
    assert raw.startswith(b"%PDF") and b"/Count 3" in raw and all(f"строка \\(line\\) {k}".encode("cp1251") in raw for k in range(150)) and b"w" * 95 in raw and b"afii10097" in raw
    at = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", raw)]
    assert all(raw[a:].startswith(b"%d 0 obj" % k) for k, a in enumerate(at, 1))
