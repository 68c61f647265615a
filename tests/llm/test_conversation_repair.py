"""repair_conversations against all edit sequences of short conversations, and against a plain walk of long ones."""

from __future__ import annotations

import itertools
import random

import pytest

from tracewell.llm.conversation_repair import ENDS, STEPS, Walk, compressed, evaluate, insertions, learn_grammar, letters, repair_conversations, repaired_digests, symbol_matrix
from tracewell.llm.queries import damaged_turns

SYMBOLS = "xsuaoSUAO"


def every_edit(seq: str) -> tuple[int, str]:
    best = (10**9, "")

    def walk(i: int, state: int, cost: int, audit: str, inserted: int) -> None:
        nonlocal best
        if i == len(seq) and state in ENDS:
            best = min(best, (cost, audit))
        for (q, role), to in STEPS.items():
            if q == state and role != "s" and inserted < 3:
                walk(i, to, cost + 2, audit + "I", inserted + 1)
            if q == state and i < len(seq) and seq[i] != "x":
                more = int(seq[i].isupper())
                if role == seq[i].lower():
                    walk(i + 1, to, cost + more, audit + "K", 0)
                if role != "s":
                    walk(i + 1, to, cost + more + 2, audit + "R", 0)
        if i < len(seq):
            walk(i + 1, state, cost + 3, audit + "D", 0)

    walk(0, 0, 0, "", 0)
    return best


def plain(seq: str) -> tuple[int, str]:
    walk, matrices = Walk(), evaluate([])
    for symbol in seq:
        walk.step(matrices[symbol])
    return walk.end({at: (cost, letters(rope)) for at, (cost, rope) in insertions().items()})


def test_walk_against_every_edit():
    rng = random.Random(1)
    seqs = ["".join(x) for n in range(4) for x in itertools.product(SYMBOLS, repeat=n)] + ["".join(rng.choices(SYMBOLS, k=4)) for _ in range(150)]
    for seq in seqs:
        assert plain(seq) == every_edit(seq), seq


def test_rules_are_the_products_of_their_symbols(spark):
    rng = random.Random(2)
    seqs = ["".join(rng.choices("uaUAsx", [5, 5, 1, 1, 1, 1], k=rng.randint(1, 80))) for _ in range(60)]
    frame = spark.createDataFrame([(x, 1 + len(x) % 3) for x in seqs], "seq string, n long")
    rules = learn_grammar(frame, 6, 40)
    assert len(rules) > 10
    matrices = evaluate(rules)
    closing = {at: (cost, letters(rope)) for at, (cost, rope) in insertions().items()}
    short = [x.seq for x in frame.select(compressed(frame.seq, rules).alias("seq")).collect()]
    assert sum(map(len, short)) < 0.6 * sum(map(len, seqs))
    for long, seq in zip(seqs, short, strict=True):
        walk = Walk()
        for symbol in seq:
            walk.step(matrices[symbol])
        assert walk.end(closing) == plain(long)
    assert symbol_matrix("x") != symbol_matrix("o")


def told(rows: list[tuple]) -> dict:
    """What the contract says of each conversation, by a plain reading of it; rows (conv, turn, role, text) in order."""
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        own = [(r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in own]
        seen, faults = set(), []
        for _, role, text in own:
            solid = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [role[:1] if role[:1] in ("s", "u", "a") else "o" for _, role, _ in own]
        seq = "".join("x" if f in ("blank", "duplicate") else i.upper() if f else i for i, f in zip(initials, faults, strict=True))
        cost, audit = plain(seq)
        state, at, lines = 0, 0, []
        for letter in audit:
            if letter == "I":
                role, text = ("assistant" if state == 2 else "user"), ""
            else:
                _, role, text = own[at]
                if letter == "R":
                    role = "assistant" if state == 2 else "user"
                at += 1
            if letter != "D":
                state = STEPS[state, role[0]]
                lines.append((role, text))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[c] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit), lines
    return out


def check(spark, rows: list[tuple], **settings) -> None:
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, audit string")
    report, repaired = repair_conversations(frame, **settings)
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in report.collect()}
    lines: dict = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.position, r.part)):
        lines.setdefault(r.conv_id, []).append((r.role, r.text))
    expected = told(rows)
    assert found == {c: figures for c, (figures, _) in expected.items()}
    assert lines == {c: x for c, (_, x) in expected.items() if x}


def test_conversations_of_every_kind(spark):
    rng = random.Random(3)
    texts = ["Yes.", "Well", "", " \t", "What?", "a\nb!", None, "No. ", "x" * 70_000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None]
    rows = [(c, t, rng.choices(roles, [6, 6, 2, 1, 1, 1])[0], f"{c} {t}." if rng.random() < 0.6 else rng.choice(texts)) for c in [None, *range(40)] for t in range(rng.randint(1, 9)) if rng.random() < 0.8]
    check(spark, rows, segment=3)


def test_one_conversation_of_many_segments(spark):
    rng = random.Random(4)
    rows = [(7, t, rng.choices(["user", "assistant"], [3, 2])[0], f"{t} said{rng.choice(['.', '.', ''])}") for t in range(3000)]
    check(spark, [*rows, (8, None, "user", "Hi."), (8, 4, "assistant", "Hi.")], segment=64)


def test_ties_repeats_nulls_and_empty_table(spark):
    rows = [(1, 0, "user", "Same."), (1, 0, "user", "Same."), (1, None, "assistant", "Before."), (2, None, "user", None), (3, None, "system", "Only.")]
    check(spark, rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    report, repaired = repair_conversations(frame.limit(0))
    assert report.collect() == [] and repaired.collect() == [] and repaired_digests(repaired).collect() == []


def test_damage_leaves_nulls_as_one_space(spark):
    frame = spark.createDataFrame([(None, None, None, None)] + [(c, t, "user", "A. B!") for c in range(30) for t in range(3)], "conv_id long, turn long, role string, text string")
    rows = damaged_turns(frame).collect()
    assert {len(r) for r in rows} == {4} and all(r.role is not None and r.text is not None for r in rows)
    assert {r.text for r in rows} >= {"A. B!", "", "A B"}


@pytest.mark.parametrize("seq", ["", "x", "xx", "s", "a", "u", "ua", "sua", "S"])
def test_small_patterns(seq):
    assert plain(seq) == every_edit(seq)
