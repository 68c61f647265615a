"""From questions to verdicts on a small table: trimming, cutting, numbering, citations."""

from __future__ import annotations

from tracewell.operators import ask

CANDIDATES = "query_id long, rank int, chunk_id string, label string, document_id long, ordinal int, start_line long, end_line long, content string"


def test_ask(spark):
    rows = [
        (1, 2, "b", "x.sql", 7, 1, 3, 5, "three four\nfive"),
        (1, 0, "a", "x.sql", 7, 0, 1, 3, "one two\nthree four"),
        (1, 5, "c", None, 8, 0, None, None, "z" * 600),
        (1, 6, "d", "w", 9, 0, None, None, "never sent"),
        (2, 0, "e", "w", 9, 0, None, None, None),
    ]
    questions = spark.createDataFrame([(1, "What?"), (2, None), (3, "q" * 2000)], "query_id long, text string")
    prompts, sources = ask.compose(questions, spark.createDataFrame(rows, CANDIDATES), 150)
    told = {r.query_id: r for r in prompts.collect()}
    sent = {(r.query_id, r.source_id): r for r in sources.collect()}
    assert {k: (r.chunk_id, r.decision) for k, r in sent.items()} == {(1, "F1"): ("a", "selected"), (1, "F2"): ("b", "selected"), (1, "F3"): ("c", "cut"), (2, "F1"): ("e", "selected")}
    assert sent[1, "F2"].content == "\nfive"  # what a ends with is said once
    assert told[1].prompt.startswith(ask.INSTRUCTIONS + "Question:\nWhat?\n\nSources:\n[F1] x.sql\none two\nthree four\n[F2] x.sql\n\nfive\n[F3] \nzz")
    assert all(r.prompt_tokens <= 150 or r.n_sources == 0 for r in told.values()) and all(-(-len(r.prompt) // 4) == r.prompt_tokens for r in told.values())
    assert (told[2].result, told[3].result, told[3].n_sources) == ("fits", "fixed_overhead_exceeds_budget", 0)
    answers = ask.first_lines(sources)
    assert {r.query_id: r.text for r in answers.collect()} == {1: "one two [F1]\n [F2]", 2: " [F1]"}
    verdicts = {r.query_id: (r.n_valid, r.n_unused, r.verdict) for r in ask.verify(answers, sources).collect()}
    assert verdicts == {1: (2, 1, "valid"), 2: (1, 0, "valid")}
    wrong = spark.createDataFrame([(1, "It is [F4]."), (3, "It is [F1].")], "query_id long, text string")
    assert {r.query_id: r.verdict for r in ask.verify(wrong, sources).collect()} == {1: "unknown_citation", 3: "unknown_citation"}
