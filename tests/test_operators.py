from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions import vectors as V
from tracewell.operators import context, evaluation, graph, incremental, inventory, resolution, retrieval
from tracewell.sources import dml


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    lit = F.lit
    assert [one(spark, T.estimate_tokens(lit(x))) for x in ("", "abcd", "abcde", "é" * 9)] == [1, 1, 2, 3]
    assert one(spark, T.normalize_newlines(lit("\ufeffa\r\nb\rc"))) == "a\nb\nc"
    assert one(spark, T.snippet(lit("  a \n b "))) == "a b" and len(one(spark, T.snippet(lit("x" * 300)))) == 240
    assert one(spark, T.word_tokens(lit("¿Dónde a_1 2 2?"))) == ["d", "nde", "a_1", "2"]
    assert one(spark, T.important_tokens(lit("Configuración f12 abc a_b tablas"), ["tablas"])) == ["configuracion", "a_b"]
    assert one(spark, T.symbol_name(lit(' "Pkg" . Proc.'))) == "pkg.proc"
    assert one(spark, T.citations(lit("a [F2] b [F1] [F2] [X]"))) == ["F2", "F1"]
    assert one(spark, T.claims(lit("One. Two!\nThree"))) == ["One.", "Two!", "Three"]
    assert one(spark, T.truncate_to_tokens(lit("abcdefghij"), lit(2))) == "abcde..."
    assert one(spark, T.json_or_empty(lit("{bad"))) == {} and one(spark, T.json_or_empty(lit('{"a": 1}'))) == {"a": "1"}
    assert one(spark, T.folder_of(lit("a/b/c.SQL"))) == "a/b" and one(spark, T.extension_of(lit("a/b/c.SQL"))) == ".sql"
    assert one(spark, V.cosine(F.array(lit(0.0)), F.array(lit(1.0)))) == 0.0
    assert abs(one(spark, T.keyword_score(lit("the Cat the"), ["the", "dog"])) - 0.6) < 1e-12


def test_hybrid_keeps_both_scores(spark):
    vector = spark.createDataFrame([("c1", 0.8)], "chunk_id string, score double")
    keyword = spark.createDataFrame([("c1", 0.6), ("c2", 0.2)], "chunk_id string, score double")
    rows = [tuple(r) for r in retrieval.hybrid_fusion(vector, keyword, 0.5, 0.5, 5).collect()]
    assert rows == [("c1", 0.8, 0.6, 1.0), ("c2", None, 0.2, 0.0)]


def test_reuse_and_centrality(spark):
    schema = "source string, target string, file_id long, relation_type string"
    nodes = spark.createDataFrame([(x,) for x in "ABCX"], "symbol_id string")
    edges = spark.createDataFrame([("A", "X", 1, "calls"), ("B", "X", 2, "calls"), ("X", "C", 3, "uses")], schema)
    reuse = {r.symbol_id: (r.distinct_sources, r.repeated, r.status) for r in graph.component_reuse(nodes, edges).collect()}
    assert reuse["X"] == (2, 0, "not_evaluated") and reuse["A"] == (0, 0, "insufficient_evidence")
    assert {r.symbol_id: r.neighbours for r in graph.structural_centrality(nodes, edges).collect()} == {"A": 1, "B": 1, "C": 1, "X": 3}
    same = spark.createDataFrame([("A", "X", 1, "calls")] * 3, schema)
    assert graph.component_reuse(nodes, same).filter("symbol_id = 'X'").first()[1:4] == (1, 3, 1)


def test_walk_has_depths_and_cycle(spark):
    edges = spark.createDataFrame([("root", "worker", "r1", "calls"), ("worker", "leaf", "r2", "calls"), ("leaf", "root", "r3", "calls")], "source string, target string, relation_id string, relation_type string")
    nodes, walked = graph.walk(edges, spark.createDataFrame([("root",)], "node string"), "outgoing", 3)
    assert {(r.node, r.depth) for r in nodes.collect()} == {("root", 0), ("worker", 1), ("leaf", 2)}
    assert sorted((r.relation_id, r.is_new) for r in walked.collect()) == [("r1", True), ("r2", True), ("r3", False)]


def test_expansion_limits(spark):
    edges = spark.createDataFrame([("a", "b", "r1", "calls"), ("a", "c", "r2", "calls")], "source string, target string, relation_id string, relation_type string")
    seeds = spark.createDataFrame([(1, "a", 0.9), (1, "z", 0.1)], "query_id long, node string, score double")
    assert [(r.neighbour, r.status) for r in graph.expand(edges, seeds, 2, 1, 5).orderBy("relation_id").collect()] == [("b", "accepted"), ("c", "limit")]
    assert [(r.neighbour, r.status) for r in graph.expand(edges, seeds, 2, 5, 1).orderBy("relation_id").collect()] == [("b", "accepted"), ("c", "limit")]


def test_resolution(spark):
    symbols = spark.createDataFrame(
        [("s1", "procesar", "pkg_cliente", "procedure", "oracle"), ("s2", "procesar", None, "table", "oracle"), ("s3", "procesar", "otro", "procedure", "oracle")],
        "symbol_id string, name string, container string, symbol_type string, technology string",
    )
    refs = spark.createDataFrame(
        [("r1", "pkg_cliente.procesar", "call", "oracle", None, False, False), ("r2", "procesar", "call", "oracle", None, False, False), ("r3", "procesar", "call", "unknown", "otro", False, False), ("r4", "none", "call", "oracle", None, False, False), ("r5", "dynamic.sql", "dynamic_sql", "oracle", None, True, False)],
        "reference_id string, target string, reference_type string, technology string, container string, dynamic boolean, external boolean",
    )
    found = resolution.candidates(refs, symbols, resolution.compatible_types(spark))
    relations = resolution.resolve(refs, found)
    assert {(r.reference_id, r.status, r.target_symbol_id) for r in relations.collect()} == {("r1", "resolved", "s1"), ("r2", "ambiguous", None), ("r3", "resolved", "s3"), ("r5", "dynamic", None)}
    assert [(r.symbol_id, r.rank) for r in resolution.rank_candidates(relations, found).orderBy("rank").collect()] == [("s3", 1), ("s1", 2)]
    assert [one(spark, resolution.relation_type(F.lit(x))) for x in ("call", "open", "table")] == ["calls", "opens", "uses"]


def test_incremental(spark):
    found = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 2, None), ("c", 1, 2, "x"), ("d", 1, 2, "y"), ("e", 1, 1, "x")], "path string, size_bytes long, modified_ns long, sha256 string")
    known = spark.createDataFrame([(p, 1, 1, "x", "s", "processed") for p in "abcd"], "path string, size_bytes long, modified_ns long, sha256 string, signature string, status string")
    got = {r.path: (r.decision, r.process) for r in incremental.file_decisions(found, known, "s").collect()}
    assert got == {"a": ("unchanged", False), "b": ("hash_required", False), "c": ("touch", False), "d": ("content_changed", True), "e": ("new", True)}
    assert {r.decision for r in incremental.file_decisions(found, known, "s", full=True).collect()} == {"full"}
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 10)], "id long, v string, created_at long")
    new = spark.createDataFrame([(2, "c", 20), (3, "d", 20)], "id long, v string, created_at long")
    assert {tuple(r) for r in incremental.upsert(old, new, ["id"]).collect()} == {(1, "a", 10), (2, "c", 10), (3, "d", 20)}
    assert {tuple(r) for r in incremental.union_first([old, new], "id").collect()} == {(1, "a", 10), (2, "b", 10), (3, "d", 20)}
    assert {tuple(r)[:2] for r in incremental.replace_children(old, new, "id").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    files = spark.createDataFrame([("r", "a"), ("r", "b"), ("q", "c")], "root string, path string")
    assert [r.path for r in incremental.deleted_files(files, files.filter("path = 'a'"), ["r"]).collect()] == ["b"]


def test_context(spark):
    rows = [(1, "a", "h1", 0.95, 2, 0, "x" * 40), (1, "b", "h2", 0.6, 1, 0, "y" * 40), (1, "c", "h1", 0.9, 3, 0, "x" * 40), (1, "d", "h4", 0.1, 4, 0, "z"), (1, "e", "h5", 0.5, 5, 0, "w" * 400)]
    table = spark.createDataFrame(rows, "query_id long, chunk_id string, sha256 string, score double, document_id long, ordinal int, content string")
    got = {r.chunk_id: (r.source, r.decision) for r in context.select_context(table, 40, 0.2).collect()}
    assert got == {"a": ("F2", "selected"), "b": ("F1", "selected"), "c": (None, "duplicate_content"), "d": (None, "threshold"), "e": ("F3", "selected")}
    docs = spark.createDataFrame([(1, "one two\n\nthree " + "word " * 40), (2, " "), (3, None)], "document_id long, text string")
    chunks = context.chunk_documents(docs, 60, 10).orderBy("ordinal").collect()
    assert all(len(r.content) <= 60 and r.document_id == 1 for r in chunks) and chunks[0].content == "one two"
    assert chunks[-1].end_char == len("one two\n\nthree " + "word " * 40)


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, "a", 2), (1, "b", 7)], "question_id long, item string, rank int")
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "question_id long, item string")
    got = {r.question_id: tuple(r)[1:] for r in evaluation.retrieval_metrics(ranked, expected).collect()}
    assert got == {1: (0.5, 1.0, 0.5), 2: (0.0, 0.0, 0.0)}
    answers = spark.createDataFrame([(1, "Uses table A", [["table", "a"], ["view"]], [["never"]]), (2, "x", [], [])], "answer_id long, text string, facts array<array<string>>, forbidden array<array<string>>")
    assert {r.answer_id: r.score for r in evaluation.answer_scores(answers).collect()} == {1: 0.65, 2: None}
    models = spark.createDataFrame([("a", 1.0, 0.95, 0.5, 10.0), ("b", 1.0, 0.95, 0.6, 99.0), ("c", 0.9, 1.0, 1.0, 1.0)], "model string, completion double, acceptance double, mean_score double, median_ms double")
    assert evaluation.recommend(models).first().model == "b"


def test_percentiles_take_the_lower_value(spark):
    rows = spark.createDataFrame([(x,) for x in (1, 1, 2, 4)], "v long")
    assert {(r.share, r.value) for r in inventory.lower_percentiles(rows, "v", [0.5, 0.9, 1.0]).collect()} == {(0.5, 1), (0.9, 2), (1.0, 4)}


def test_dml(spark):
    script = "INSERT INTO cfg.Rule (a, b, c, d, e, f) VALUES ('a;b', 'c'';d', -1.5, NULL, DATE '2020-01-01', fn(1, 'x,y'));\nPROMPT hi; there\nUPDATE cfg.rule SET a = :t, b = 'AND' WHERE id = 1 AND k = 'z';\nBEGIN x; END;\nINSERT INTO t (a) VALUES ('open"
    docs = spark.createDataFrame([(1, script)], "document_id long, text string")
    found = dml.statements(docs)
    assert [(r.start_line, r.terminated) for r in found.orderBy("ordinal").collect()] == [(1, True), (3, True), (4, True), (4, True)]
    rows = [(r.ordinal, r.table_name, r.column_name, r.value, r.value_type, r.is_key) for r in dml.records(found).orderBy("ordinal", "column_name").collect()]
    assert [x[4] for x in rows[:6]] == ["string", "string", "number", "null", "date_literal", "function_expression"]
    assert rows[6:] == [(1, "cfg.rule", "a", ":t", "placeholder", False), (1, "cfg.rule", "b", "'AND'", "string", False), (1, "cfg.rule", "id", "1", "number", True), (1, "cfg.rule", "k", "'z'", "string", True)]
