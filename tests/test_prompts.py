"""Budgets of prompts, the exchange for a graph's evidence, and structured search, on small tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tracewell.operators import prompts, structured

SOURCES = "query_id long, rank long, head_chars long, content_chars long, chunk_id string, content_key string, is_graph boolean"


def folded(sources, overhead, budget, least=8):
    """Source after source, as the rule is told."""
    used, over, out = overhead, False, {}
    for rank, head, chars in sources:
        left = (4 * budget - used - head) // 4
        if not over and used + head + chars <= 4 * budget:
            out[rank], used = ("selected", chars), used + head + chars
        elif not over and left >= least:
            out[rank], used, over = ("cut", min(chars, 4 * left)), used + head + min(chars, 4 * left), True
        else:
            out[rank], over = ("budget", 0), True
    return out, used


def test_fit_prompts_against_a_fold(spark):
    rng = random.Random(1)
    queries = {q: ([(i, rng.randint(0, 20), rng.choice([0, 3, 40, 200, 900])) for i in range(rng.randint(0, 12))], rng.randint(0, 500)) for q in range(60)}
    rows = [(q, i, h, c, f"{q}-{i}", f"{i}", False) for q, (sources, _) in queries.items() for i, h, c in sources]
    overheads = spark.createDataFrame([(q, o) for q, (_, o) in queries.items()], "query_id long, overhead_chars long")
    fitted, told = prompts.fit_prompts(spark.createDataFrame(rows, SOURCES), overheads, 100)
    found = {(r.query_id, r["rank"]): (r.decision, r.chars_sent) for r in fitted.collect()}
    report = {r.query_id: r for r in told.collect()}
    for q, (sources, overhead) in queries.items():
        expected, used = folded(sources, overhead, 100)
        assert {i: found[q, i] for i, _, _ in sources} == expected
        sent = sum(d != "budget" for d, _ in expected.values())
        assert (report[q].n_sources, report[q].prompt_tokens) == (sent, -(-used // 4))
        assert report[q].result == ("fixed_overhead_exceeds_budget" if overhead > 400 else "fits" if sent else "insufficient_evidence")
        assert report[q].prompt_tokens <= max(100, -(-overhead // 4))


def exchanged(spark, rows, budget=60):
    overheads = spark.createDataFrame([(1, 40)], "query_id long, overhead_chars long")
    out, report = prompts.exchange_for_graph(spark.createDataFrame([(1, *r) for r in rows], SOURCES), overheads, budget)
    r = report.first()
    return {x["rank"]: x.decision for x in out.collect()}, (r.triggered, r.applied, r.candidate_rank, r.replaced_rank)


def test_exchange_for_graph(spark):
    a, b, c = (0, 10, 90, "a", "A", False), (1, 10, 90, "b", "B", False), (2, 10, 80, "c", "C", False)
    found, report = exchanged(spark, [a, b, c, (3, 10, 70, "g", "G", True), (4, 10, 70, "h", "H", True)])
    assert report == (True, True, 3, 1) and found == {0: "selected", 1: "budget_fallback", 2: "budget", 3: "selected", 4: "budget"}
    # one that is sent already, none at all, and one whose content is there
    assert exchanged(spark, [(0, 10, 90, "g", "G", True), b, c])[1] == (False, False, None, None)
    assert exchanged(spark, [a, b, c])[1] == (False, False, None, None)
    found, report = exchanged(spark, [a, b, c, (3, 10, 70, "g", "A", True)])
    assert report == (True, False, 3, 1) and found[1] == "selected" and found[3] == "budget"
    # the graph's candidate would leave fewer sources
    small = [(i, 10, 20, f"s{i}", f"S{i}", False) for i in range(6)]
    assert exchanged(spark, [(0, 0, 150, "x", "X", False), (1, 0, 40, "y", "Y", False), (2, 500, 900, "g", "G", True)])[1][:2] == (True, False)
    assert exchanged(spark, [*small, (6, 10, 90, "g", "G", True)])[1][0]


def test_concepts(spark):
    words = ["reglas", "acciones", "raices", "veces", "crisis", "dos", "luz_roja_y_reglas", "iones", "as_b"]
    found = {r.t: r.v for r in spark.createDataFrame([(w,) for w in words], "t string").select("t", structured.concept_variants(F.col("t")).alias("v")).collect()}
    assert found == {
        "reglas": ["regla", "reglas"], "acciones": ["accion", "acciones"], "raices": ["raices", "raiz"], "veces": ["vece", "veces"], "crisis": ["crisis"], "dos": ["dos"], "luz_roja_y_reglas": ["luz_roja_y_reglas", "regla", "reglas", "roja"], "iones": ["ione", "iones"], "as_b": ["as_b"],
    }
    row = spark.createDataFrame([("¿Qué REGLAS usa la regla a_1 de f12? Reglas", "pkg.proc"), ], "a string, b string")
    got = row.select(structured.concept_groups(F.col("a"), ["usa"]).alias("g"), structured.query_identifiers(F.col("a")).alias("i"), structured.query_identifiers(F.col("b")).alias("q")).first()
    assert (got.g, got.i, got.q) == ([["regla", "reglas"], ["regla"], ["a_1"]], ["a_1"], [])


def test_structured_candidates(spark):
    questions = spark.createDataFrame([(1, "precio de facturas"), (2, "rules.x"), (3, "de la")], "query_id long, text string")
    symbols = spark.createDataFrame(
        [
            ("r1", "r1", "Factura", "rules.x", ["factura"], [], [], ["configuration"]),
            ("f1", "r1", "expr", "rules.x.f", [], ["precio", "factura"], [], []),
            ("r2", "r2", "Otro", "rules.y", [], [], ["precio"], []),
            ("r3", "r3", "Nada", "rules.z", ["nada"], [], [], []),
        ],
        "symbol_id string, record_id string, original_name string, normalized_name string, names array<string>, declared_values array<string>, descriptive array<string>, structural array<string>",
    )
    scores = structured.structured_scores(questions, symbols, [])
    found = {(r.query_id, r.symbol_id): (r.matched, r.score) for r in scores.collect()}
    assert {k: n for k, (n, _) in found.items()} == {(1, "r1"): 1, (1, "f1"): 2, (1, "r2"): 1} and found[1, "f1"][1] > found[1, "r1"][1] > found[1, "r2"][1]
    roots = spark.createDataFrame([("f1", "f1"), ("f1", "r1"), ("r1", "r1"), ("r2", "r2")], "symbol_id string, root_id string")
    relations = spark.createDataFrame([("r1", "b", 10), ("f1", "a", 11), ("r2", "c", 10), ("r2", "d", 12)], "root_id string, relation_id string, chunk_id long")
    rows = [(r.kind, r.symbol_id, r.chunk_id) for r in structured.structured_candidates(scores, roots, relations, 5).orderBy("rank").collect()]
    assert rows == [("structured", "f1", None), ("related", "f1", 11), ("related", "f1", 10), ("structured", "r2", None), ("related", "r2", 12)]
    assert structured.structured_candidates(scores, roots, relations, 2).count() == 2


def test_sources_are_fitted_once(spark):
    """The decisions start from written sources: none of their inputs is read again for an exchange."""
    overheads = spark.createDataFrame([(1, 40)], "query_id long, overhead_chars long")
    sources = spark.createDataFrame([(1, i, 10, 90, f"s{i}", f"S{i}", i == 3) for i in range(5)], SOURCES)
    out, _ = prompts.exchange_for_graph(sources, overheads, 60)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan
