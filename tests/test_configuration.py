"""Declarative configuration: statements of many shapes, symbols, lineage and references on small tables."""

from __future__ import annotations

from tracewell.operators import configuration as C
from tracewell.sources import configuration as S

DECLARED = "configuration string, role string, column_name string, position int, target_configuration string, target_technology string, target_type string, relation_type string, values_active array<string>, values_inactive array<string>"
COLUMNS = [("table", "APP.Rules"), ("identity", "ID"), ("identity", "ver"), ("default", "id"), ("default", "ver"), ("default", "expr"), ("name", "title"), ("formula", "expr"), ("rule", "cond"), ("variable", "v"), ("parameter", "p")]


def declared(spark, more=()):
    rows = [("rules", role, column, i, None, None, None, None, None, None) for i, (role, column) in enumerate(COLUMNS)]
    rows += [("rules", "status", "state", 50, None, None, None, None, [" 'On' "], ["off"]), ("other", "table", "x.plain", 0, None, None, None, None, None, None), ("other", "identity", "k", 1, None, None, None, None, None, None)]
    return spark.createDataFrame([*rows, *more], DECLARED)


def read(spark, script, **limits):
    records, diagnostics = S.read_configurations(spark.createDataFrame([(1, script), (2, None), (3, "")], "document_id long, text string"), declared(spark), **limits)
    return {r.ordinal: r for r in records.collect()}, {r.ordinal: (r.statement_type, r.reason, r.severity) for r in diagnostics.collect()}


STATEMENTS = [
    ("insert into app.rules (id, \"VER\", expr) values (1, 'a;b', 'f(x, ''y'')')", None),
    ("INSERT INTO Rules VALUES (2, 1, nvl((a + b), 3) -- the end\n)", None),
    ("INSERT INTO rules (id) VALUES (3)", ("insert", "missing_identity", "error")),
    ("INSERT INTO rules (id, ver) VALUES (4)", ("insert", "column_value_mismatch", "error")),
    ("INSERT INTO plain VALUES (1)", ("insert", "missing_default_column_order", "error")),
    ("INSERT INTO unknown (a) VALUES (1)", ("insert", "undeclared_table", "warning")),
    ("INSERT INTO rules (id, ver) VALUES (5", ("insert", "malformed_insert", "error")),
    ("INSERT INTO rules (id, ver)", ("insert", "malformed_insert", "error")),
    ("INSERT ALL INTO rules VALUES (1, 2, 3)", ("insert", "unsupported_insert", "warning")),
    ("INSERT INTO rules (id, ver) VALUES ((SELECT 1), 2)", ("insert", "unsupported_insert", "warning")),
    ("UPDATE rules SET expr = 'IN OR LIKE', v = (1 + 2) WHERE ver = 1 AND id = 2", None),
    ("UPDATE rules SET expr = 1 WHERE id = 2", ("update", "missing_identity_where", "error")),
    ("UPDATE rules SET expr WHERE id = 2 AND ver = 1", ("update", "missing_set", "error")),
    ("UPDATE rules SET expr = 1 WHERE id > 2", ("update", "unsupported_where", "warning")),
    ("UPDATE rules SET expr = 1 WHERE id IN (2)", ("update", "unsupported_update", "warning")),
    ("UPDATE rules SET expr = 1", ("update", "malformed_update", "error")),
    ("COMMIT", ("commit", "unsupported_statement", "warning")),
    ("DECLARE x number", ("plsql_block", "unsupported_statement", "warning")),
    ("INSERT INTO rules (id, ver) VALUES (6, 6)", "inside"),
    ("END do_it", "inside"),
    ("INSERT INTO rules (id, ver, expr) VALUES (7, 1, '" + "x" * 60 + "')", ("insert", "max_literal_chars", "error")),
    ("DELETE FROM rules", ("unknown", "unsupported_statement", "warning")),
]


def test_every_statement_is_a_record_or_says_why_not(spark):
    records, diagnostics = read(spark, ";\r\n".join(s for s, _ in STATEMENTS) + ";", most_chars=50)
    for i, (statement, expected) in enumerate(STATEMENTS, 1):
        assert (i in records) == (expected is None), statement
        assert diagnostics.get(i) == (None if expected in (None, "inside") else expected), statement
    first, update = records[1], records[11]
    assert [(v.column, v.raw, v.value_type, v.is_identity) for v in first["values"]] == [("id", "1", "number", True), ("ver", "'a;b'", "string", True), ("expr", "'f(x, ''y'')'", "string", False)]
    assert [v.column for v in update["values"]] == ["ver", "id", "expr", "v"] and update.partial and update.operation == "update"
    assert [v.raw for v in records[2]["values"]] == ["2", "1", "nvl((a + b), 3)"]
    assert (first.start_line, records[2].start_line, records[2].end_line) == (1, 2, 3)


def test_too_many_statements(spark):
    records, diagnostics = read(spark, "COMMIT;" * 4, most_statements=3)
    assert records == {} and diagnostics == {4: ("limit", "max_statements_per_file", "error")}


def test_many_statements_are_all_read(spark):
    n = 10_001
    records, diagnostics = read(spark, "\n".join(f"INSERT INTO rules (id, ver) VALUES ({i}, 1);" for i in range(n)))
    assert diagnostics == {} and sorted(records) == list(range(1, n + 1))
    assert all(r.start_line == r.end_line == i for i, r in records.items())


def test_symbols(spark):
    script = "INSERT INTO rules (id, ver, title, expr, v, state) VALUES (1, 'x y', 'The ''rule''', NULL, 'var', 'OFF'); UPDATE rules SET expr = 'a' WHERE id = 1 AND ver = 'x y'; INSERT INTO rules (id, ver, state) VALUES (2, '--', 'odd');"
    records, _ = S.read_configurations(spark.createDataFrame([(1, script)], "document_id long, text string"), declared(spark))
    symbols, again = C.configuration_symbols(records, declared(spark))
    found = {r.normalized_name: r for r in symbols.collect()}
    assert set(found) == {"rules", "rules.1.x_y", "rules.1.x_y.configuration_variable.v", "rules.1.x_y.configuration_formula.expr", "rules.2.--".replace("--", "value")}
    assert (found["rules.1.x_y"].original_name, found["rules.1.x_y"].status, found["rules.1.x_y"].confidence) == ("The 'rule'", "stale", "high")
    assert found["rules.1.x_y"].parent_id == found["rules"].symbol_id and found["rules.2.value"].status == "active"
    assert found["rules.1.x_y.configuration_formula.expr"].status == "active"  # from the update, which names no state
    assert [(r.ordinal, r.reason) for r in again.collect()] == [(2, "duplicate_record")]


def test_lineage(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None, "configuration_record" if i % 10 == 0 else "x") for i in range(60)] + [("a", "b", "x"), ("b", "a", "x"), ("c", "a", "configuration_record"), ("lost", "nowhere", "x"), ("self", "self", "x")]
    found = {r.symbol_id: r for r in C.lineage(spark.createDataFrame(rows, "symbol_id string, parent_id string, symbol_type string")).collect()}
    assert all((found[f"n{i}"].root_id, found[f"n{i}"].depth, found[f"n{i}"].nearest_id) == ("n0", i, f"n{i // 10 * 10}") for i in range(60))
    assert [found[x].cyclic for x in ("a", "b", "c", "self", "lost")] == [True] * 4 + [False]
    assert (found["lost"].root_id, found["lost"].depth, found["c"].nearest_id, found["a"].root_id) == ("lost", 0, "c", None)
    assert C.lineage(spark.createDataFrame([], "symbol_id string, parent_id string, symbol_type string")).collect() == []


def test_references(spark):
    more = [("rules", "reference", "target", 60, None, "oracle", "Procedure", None, None, None), ("rules", "reference", "nxt", 61, "rules", None, None, "precedes", None, None), ("rules", "parent", "owner", 62, "rules", None, None, None, None, None)]
    script = """INSERT INTO rules (id, ver, expr, cond, v, p, target, nxt, owner) VALUES (1, 1, '[@ a b ] + F1([%rate]) + round(G(x)) + CASE (1)', 'rate > lim and lim', 'lim', 'rate', 'PKG.Run', ':later', NULL);
    INSERT INTO rules (id, ver, expr, nxt) VALUES (2, 1, 'H(x || y', '${other}');"""
    patterns = spark.createDataFrame([("rules", r"\[@([^\]]+)\]", 1), ("rules", r"\[%([^\]]+)\]", 1), ("rules", r"\b(rate|lim)\b", 0), ("none", ".", 0)], "configuration string, pattern string, token_group int")
    records, _ = S.read_configurations(spark.createDataFrame([(1, script)], "document_id long, text string"), declared(spark, more))
    found = {(r.ordinal, r.reference_type, r.normalized_target): r for r in C.configuration_references(records, declared(spark, more), patterns).collect()}
    assert set(found) == {
        (1, "calls", "pkg.run"), (1, "precedes", "rules.later"), (1, "configuration_token", "rules.a_b"), (1, "configuration_token", "rules.rate"), (1, "configuration_token", "rules.lim"), (1, "function_candidate", "f1"),
        (1, "function_candidate", "round"), (1, "function_candidate", "g"), (2, "precedes", "rules.other"), (2, "function_candidate", "h"),
    }
    assert (found[1, "calls", "pkg.run"].technology, found[1, "calls", "pkg.run"].resolution_status) == ("oracle", "unresolved")
    assert {found[k].resolution_status for k in [(1, "precedes", "rules.later"), (2, "precedes", "rules.other"), (2, "function_candidate", "h")]} == {"dynamic"}
    assert (found[1, "configuration_token", "rules.a_b"].token_kind, found[1, "configuration_token", "rules.lim"].token_kind, found[1, "configuration_token", "rules.rate"].token_kind) == ("variable", "variable", "parameter")
    assert found[1, "function_candidate", "round"].external and not found[1, "function_candidate", "g"].external


def test_files_and_metrics(spark):
    files = spark.createDataFrame([(1, "a/x.sql", "insert into APP . \"Rules\" values (1)"), (2, "a/x.txt", "update rules set"), (3, "b/y.SQL", "update other_table set"), (4, "b/z.sql", None)], "document_id long, relative_path string, text string")
    assert [(r.document_id, r.configurations) for r in S.configuration_scripts(files, declared(spark)).collect()] == [(1, ["rules"])]
