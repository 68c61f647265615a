from __future__ import annotations

import io
import zipfile

from tracewell.sources import code, files
from tracewell.streaming import ingest


def test_discovery_decoding_and_fingerprint(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.PKB").write_bytes(b"select 1")
    (tmp_path / "sub/b.md").write_bytes("ü".encode("cp1252"))
    (tmp_path / "sub/skip.md").write_bytes(b"x")
    (tmp_path / "big.txt").write_bytes(b"x" * 100)
    (tmp_path / "c.exe").write_bytes(b"x")
    found = files.discover(spark, str(tmp_path), [".pkb", ".md", ".txt"], ["*skip*"], 50)
    rows = {r.relative_path: r for r in files.decode(found).collect()}
    assert set(rows) == {"a.PKB", "sub/b.md", "big.txt"}
    assert rows["a.PKB"].artifact_kind == "oracle" and rows["a.PKB"].text == "select 1"
    assert rows["sub/b.md"].encoding == "cp1252" and rows["sub/b.md"].text == "ü" and rows["sub/b.md"].media_type == "text/markdown"
    assert rows["big.txt"].status == "FILE_TOO_LARGE" and rows["big.txt"].content is None


def test_docx(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    table = spark.createDataFrame([("a.docx", bytearray(data.getvalue())), ("b.docx", bytearray(b"no"))], "relative_path string, content binary")
    rows = [(r.relative_path, r.kind, r.level, r.text) for r in files.docx_blocks(table).orderBy("relative_path", "ordinal").collect()]
    assert rows == [("a.docx", "heading", 1, "Title"), ("a.docx", "paragraph", None, "Text"), ("a.docx", "table_row", None, "a | b"), ("b.docx", "error", None, "DOCX_UNREADABLE")]


PACKAGE = """create or replace package body pkg_client as
  -- from ignored_table
  procedure run is
  begin
    other.work(1);
    CALL pkg.step(2);
    select 'from nowhere' into x from orders o join "Items" i on 1 = 1;
    id := seq_client.nextval;
    execute immediate v_sql; /* update
    hidden */ insert into log_table values (1);
  end run;
  function last_one return number is begin return dual.x(1); end;
end pkg_client;"""


def test_oracle(spark):
    docs = spark.createDataFrame([(1, PACKAGE)], "document_id long, text string")
    # a quoted table name counts only where a word character follows it, as the pattern's boundary asks
    found = {(r.line, r.reference_type, r.target, r.confidence) for r in code.references(docs, "oracle").collect()}
    assert found == {
        (5, "call", "other.work", "medium"),
        (6, "call", "pkg.step", "high"),
        (7, "table", "orders", "high"),
        (8, "sequence", "seq_client", "high"),
        (9, "dynamic_sql", "dynamic.sql", "low"),
        (10, "table", "log_table", "high"),
    }
    units = {(r.unit_type, r.name, r.start_line, r.end_line) for r in code.oracle_objects(docs).collect()}
    assert units == {("package_body", "pkg_client", 1, 13), ("procedure", "run", 3, 11), ("function", "last_one", 12, 13)}


def test_powerbuilder(spark):
    text = "open(w_main)\nlnv.of_save(1) // open(w_no)\ntrigger event ue_go\ndw_1.dataobject = \"d_list\"\nSELECT a FROM t1 USING x;\nEXECUTE sp_do;\nEXECUTE IMMEDIATE :s;"
    docs = spark.createDataFrame([(1, text)], "document_id long, text string")
    found = {(r.line, r.reference_type, r.target) for r in code.references(docs, "powerbuilder").collect()}
    assert found == {
        (1, "open", "w_main"),
        (2, "call", "lnv.of_save"),
        (3, "event", "ue_go"),
        (4, "datawindow", "d_list"),
        (5, "table", "t1"),
        (6, "stored_procedure", "sp_do"),
        (7, "dynamic_sql", "dynamic.sql"),
        (7, "stored_procedure", "immediate"),
    }


def test_oracle_rules(spark):
    text = """CREATE OR REPLACE TRIGGER trg BEFORE INSERT ON own.accounts FOR EACH ROW
create package spec_only is
  procedure declared_only;
end spec_only;
select 'from hidden' from dual d join "Q"."t2" on x
-- from commented
open c for select 1 from (select 2 from b.c)
insert into x.y (a) values (pkg.f(1)); merge into z using w on (1 = 1); delete from gone where 1 = 1;
from
split_line"""
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "document_id long, text string")
    found = {(r.line, r.reference_type, r.target, r.confidence) for r in code.references(docs, "oracle").collect()}
    assert found == {
        (1, "trigger_table", "own.accounts", "high"), (7, "dynamic_sql", "dynamic.sql", "low"), (7, "table", "b.c", "high"), (8, "table", "x.y", "high"), (8, "call", "x.y", "medium"),
        (8, "call", "pkg.f", "medium"), (8, "table", "z", "high"), (8, "table", "gone", "high"),
    }
    units = {(r.unit_type, r.name, r.start_line, r.end_line, r.level) for r in code.oracle_objects(docs).collect()}
    assert units == {("trigger", "trg", 1, 1, 0), ("package", "spec_only", 2, 4, 0)}


def test_powerbuilder_objects(spark):
    text = """forward prototypes
public function integer of_save (string a)
end prototypes
global type w_main from window
end type
public function integer of_save (string a);
  messagebox.show(1)
  return 1
end function
event open;
  open(w_child)
end event
on w_main.create
end on
dw.retrieve="select a
from t" """
    docs = spark.createDataFrame([(1, text, ".srw"), (2, "binary", ".PBL"), (3, None, ".sru")], "document_id long, text string, extension string")
    found = {(r.document_id, r.unit_type, r.name, r.start_line, r.end_line, r.parent, r.error) for r in code.powerbuilder_objects(docs).collect()}
    assert found == {
        (1, "window", "w_main", 1, 16, None, None), (1, "function", "of_save", 6, 9, "w_main", None), (1, "event", "open", 10, 12, "w_main", None), (1, "on", "w_main.create", 13, 14, "w_main", None),
        (1, "datawindow_sql", "retrieve", 15, 16, "w_main", None), (2, "library", None, None, None, None, "UNSUPPORTED_BINARY_PBL"),
    }
    assert {(r.line, r.reference_type, r.target) for r in code.references(docs.filter("document_id = 1"), "powerbuilder").collect()} == {(4, "table", "window"), (11, "open", "w_child")}


def test_markdown(spark):
    text = "# Top\ntext\n## Sub ##\n```\n# no heading\n```\nOther\n-----\nmore\n# Next"
    docs = spark.createDataFrame([(1, text)], "document_id long, text string")
    rows = sorted((r.start_line, r.level, r.title, r.end_line) for r in code.markdown_sections(docs).collect())
    assert rows == [(1, 1, "Top", 9), (3, 2, "Sub", 6), (7, 2, "Other", 9), (10, 1, "Next", 10)]


def test_streaming_ingest_reads_each_file_once(spark, tmp_path):
    source, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("one\r\n\r\ntwo")
    for expected in (1, 2):
        ingest.ingest_stream(ingest.arriving_files(spark, source), table, state).awaitTermination(60)
        rows = spark.read.parquet(table).collect()
        assert len(rows) == expected
        (tmp_path / "in/b.md").write_text("three")
    assert {r.content for r in rows} == {"one\n\ntwo", "three"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_what_rules_find_leaves_the_lexer(spark):
    """Tokens never become rows or arrays of Spark; references are merged by hashing, objects need no window."""
    docs = spark.createDataFrame([(1, PACKAGE)], "document_id long, text string")
    for technology in ("oracle", "powerbuilder"):
        plan = _plan(code.references(docs, technology))
        assert "SortAggregate" not in plan and "kind" not in plan and "HashAggregate" in plan
    assert "Window" not in _plan(code.oracle_objects(docs)) and "kind" not in _plan(code.oracle_objects(docs))


def test_scripts_lexed_together_are_as_alone():
    """A script's tokens, lines and neighbours end with it, wherever it lies among others; a row of two scripts holds both."""
    import random

    rng = random.Random(4)
    words = ["create ", "or replace ", "trigger t ", "create or replace trigger t on b.c\n", "create package body p is\n", "procedure r is\n", "end r;\n", "end p;\n", "on a.b ", "from x.y\n", "into ", "insert ", "call q.z(", "'open\n", "-- c\n", "/* \n", "*/", '"Q"', "execute immediate ", "s.nextval ", ";", "("]
    texts = [None, "", *("".join(rng.choice(words) for _ in range(rng.randrange(14))) for _ in range(300))]
    for technology, rules in (("oracle", code._oracle_rules), ("powerbuilder", code._powerbuilder_rules)):
        of = lambda some: code._found_references(code.Tokens(some, technology), rules).to_pylist()  # noqa: B023, E731
        assert of(texts) == [x for text in texts for x in of([text])]
    units = lambda some, held=None: code._oracle_units(code.Tokens(some, "oracle", held)).to_pylist()
    alone = [x for text in texts for x in units([text])]
    assert units(texts) == alone and sum(map(len, alone)) > 100
    assert len(units(texts, [len(texts) - 1, 0, 1])) == 3 and units(texts, [0, *[1] * len(texts)]) == [[], *alone]
    assert units(["create view a as x\n", "create view a as x\n\n\n"], [2]) == [[{"unit_type": "view", "name": "a", "start_line": 1, "end_line": n, "level": 0, "parent": None} for n in (0, 4)]]
    assert any(x["reference_type"] == "trigger_table" for x in sum(code._found_references(code.Tokens(texts, "oracle"), code._oracle_rules).to_pylist(), []))
