"""Conversation structure repair: the cheapest edits that make the roles of each conversation alternate, by grammar-compressed dynamic programming.

A turn is one of nine symbols, by its role and fault. Re-Pair finds the pairs of symbols that conversations share and makes each a rule; a rule has
one min-plus matrix over the states of the wanted pattern, the product of its two parts' matrices, whose entries hold the least cost and a rope of
the edits. Rules are evaluated once, bottom-up; a conversation is then a product of the few symbols that are left of it.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import BLANKS, id_or_lowest, id_or_null, positions, written

#: The pattern (s?(ua)+)? as states: nothing yet, after s, after u, after a. A conversation may end in ENDS.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ENDS = range(4), (0, 3)
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: Turns of a conversation that one row of symbols holds, at most.
SEGMENT = 1024
#: Rounds of Re-Pair, and rules of the grammar, at most: more rules make the rest shorter and change no result.
ROUNDS, RULES = 8, 96
FIRST_RULE = 0x4E00

#: Least cost and rope of the edits: a text, or a pair of ropes.
Entry = tuple[int, "str | tuple"]
Matrix = dict[tuple[int, int], Entry]


def letters(rope: str | tuple) -> str:
    """The rope as text."""
    out, open_ = [], [rope]
    while open_:
        part = open_.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            open_ += [part[1], part[0]]
    return "".join(out)


def less(a: Entry, b: Entry | None) -> bool:
    """By cost, then by the edits' letters. Among edits of the same turns neither is the start of the other at equal cost, so order survives concatenation."""
    return b is None or a[0] < b[0] or (a[0] == b[0] and letters(a[1]) < letters(b[1]))


def product(left: Matrix, right: Matrix) -> Matrix:
    """Min-plus product; the ropes are tied together, not copied."""
    out: Matrix = {}
    for (a, b), (cost, rope) in left.items():
        for c in STATES:
            if (b, c) in right:
                then = right[b, c]
                found = (cost + then[0], (rope, then[1]))
                if less(found, out.get((a, c))):
                    out[a, c] = found
    return out


def insertions() -> Matrix:
    """No, one or more turns inserted."""
    step: Matrix = {(q, q): (0, "") for q in STATES}
    for (q, role), to in STEPS.items():
        if role in ROLES:
            step[q, to] = (INSERT, "I")
    out = step
    for _ in STATES:
        out = product(out, step)
    return out


def symbol_matrix(symbol: str) -> Matrix:
    """Insertions, then the edits of one turn. x has to go; else the role's initial (o: any other), in upper case if the text is cut off."""
    row: Matrix = {(q, q): (DELETE, "D") for q in STATES}
    if symbol != "x":
        more = TRUNCATED if symbol.isupper() else 0
        for (q, role), to in STEPS.items():
            for found in [(more, "K")] * (role == symbol.lower()) + [(REROLE + more, "R")] * (role in ROLES):
                if less(found, row.get((q, to))):
                    row[q, to] = found
    return product(insertions(), row)


def learn_grammar(strings: DataFrame, rounds: int = ROUNDS, rules: int = RULES) -> list[tuple[str, str]]:
    """Re-Pair over rows (seq, n): rules (new symbol, the two symbols that it stands for), each over the ones before it.

    Every round counts all neighbouring symbols of all rows, and takes the most frequent pairs of which no two share a symbol, so that replacing one changes no other's count.
    """
    found: list[tuple[str, str]] = []
    for _ in range(rounds):
        now = strings.select(compressed(F.col("seq"), found).alias("seq"), "n").filter(F.char_length("seq") > 1)
        pairs = now.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("seq") - 1), lambda i: F.substring("seq", i, F.lit(2)))).alias("pair"), "n")
        top = pairs.groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "pair").limit(rules).collect()
        taken: set[str] = set()
        for row in top:
            if len(found) < rules and not taken & set(row.pair):
                taken |= set(row.pair)
                found.append((chr(FIRST_RULE + len(found)), row.pair))
        if not taken:
            break
    return found


def compressed(seq: Column, rules: list[tuple[str, str]]) -> Column:
    for symbol, pair in rules:
        seq = F.replace(seq, F.lit(pair), F.lit(symbol))
    return seq


def evaluate(rules: list[tuple[str, str]]) -> dict[str, dict[tuple[int, int], tuple[int, str]]]:
    """The matrix of every symbol, rules bottom-up, with the ropes as text."""
    known = {symbol: symbol_matrix(symbol) for symbol in "xsuaoSUAO"}
    for symbol, (a, b) in rules:
        known[symbol] = product(known[a], known[b])
    return {symbol: {at: (cost, letters(rope)) for at, (cost, rope) in matrix.items()} for symbol, matrix in known.items()}


class Walk:
    """The cheapest edits of a conversation so far, by the state they lead to; what all of them begin with is set apart."""

    def __init__(self) -> None:
        self.sure: list[str] = []
        self.best: dict[int, tuple[int, str]] = {0: (0, "")}

    def step(self, matrix: dict[tuple[int, int], tuple[int, str]]) -> None:
        after: dict[int, tuple[int, str]] = {}
        for (a, b), (cost, edits) in matrix.items():
            if a in self.best:
                found = (self.best[a][0] + cost, self.best[a][1] + edits)
                if b not in after or found < after[b]:
                    after[b] = found
        shared = os.path.commonprefix([edits for _, edits in after.values()])
        if len(shared) > 256:
            self.sure.append(shared)
            after = {q: (cost, edits[len(shared) :]) for q, (cost, edits) in after.items()}
        self.best = after

    def end(self, closing: dict[tuple[int, int], tuple[int, str]]) -> tuple[int, str]:
        self.step(closing)
        cost, edits = min(self.best[q] for q in ENDS if q in self.best)
        return cost, "".join([*self.sure, edits])


def edits_with_roles(audit: str, first_is_system: bool) -> str:
    """Each letter with the role that it gives: s, u, a, or - for a turn that goes."""
    out, state = [], 0
    for letter in audit:
        role = "-"
        if letter != "D":
            role = "s" if state == 0 and letter == "K" and first_is_system else "a" if state == 2 else "u"
            state = STEPS[state, role]
        out.append(letter + role)
    return "".join(out)


def fold(rules: list[tuple[str, str]]):
    """Segments (_c, _s, seq, inits) sorted by conversation and number: rows (_c, _s, piece, cost, audit, illegal). A row per segment has its part of the
    edits with roles; the first has the conversation's figures."""
    matrices = evaluate(rules)
    closing = {at: (cost, letters(rope)) for at, (cost, rope) in insertions().items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        now, walk, held, last, illegal = None, Walk(), [], "", 0

        def close() -> None:
            cost, audit = walk.end(closing)
            kept = next((i for i, x in enumerate(re.sub("I+", "", audit)) if x != "D"), None)  # the first turn that stays
            first = kept is not None and initial_at(held, kept) == "s"
            pieces = re.findall("(?:I.)*[KRD].(?:(?:I.)+$)?", edits_with_roles(audit, first))
            at = 0
            for k, (number, inits) in enumerate(held):
                done.append((now, number, "".join(pieces[at : at + len(inits)]), cost if k == 0 else None, audit if k == 0 else None, illegal if k == 0 else None))
                at += len(inits)

        for frame in frames:
            for c, s, seq, inits in zip(frame["_c"], frame["_s"], frame["seq"], frame["inits"], strict=True):
                if held and c != now:
                    close()
                    walk, held, last, illegal = Walk(), [], "", 0
                now = c
                held.append((s, inits))
                around = last + inits
                illegal += sum(around[i : i + 2] not in ("su", "ua", "au") for i in range(len(around) - 1))
                last = inits[-1]
                for symbol in seq:
                    walk.step(matrices[symbol])
            if done:
                yield pd.DataFrame(done, columns=names).astype({"cost": "Int64", "illegal": "Int64"})
                done.clear()
        if held:
            close()
            yield pd.DataFrame(done, columns=names).astype({"cost": "Int64", "illegal": "Int64"})

    names = ["_c", "_s", "piece", "cost", "audit", "illegal"]
    return run


def initial_at(held: list[tuple[int, str]], at: int) -> str:
    for _, inits in held:
        if at < len(inits):
            return inits[at]
        at -= len(inits)
    return ""


def repair_conversations(turns: DataFrame, segment: int = SEGMENT, rounds: int = ROUNDS, rules: int = RULES) -> tuple[DataFrame, DataFrame]:
    """Faults of each conversation, and its turns after the cheapest edits that make its roles' initials match (s?(ua)+)?.

    In: conv_id, turn, role, text (others are ignored), a row per turn; a null role or text is one space. Out: a report, a row per conversation with conv_id, gaps
    (missing numbers between the least and the greatest turn), blank, duplicate, truncated (turns by their first fault), illegal (neighbours other than su, ua, au),
    cost, audit (a letter per edit); and the repaired turns, rows with conv_id, position and part (their order), role, text, edit.

    Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty user or assistant turn) 2; a cut-off turn that stays adds 1. Blank turns and those
    whose role and text were there before have to go. Among the cheapest edits the one whose letters come first in ASCII is taken.

    Order is by turn (nulls first), then role and a hash of the text; equal rows are turns of their own, all but the first of them duplicates. A role's initial is its first
    character; initials other than s, u, a are never kept. A null conv_id is a conversation and null turns are no gaps. A conversation none of whose turns stays has no
    repaired rows. An empty table gives empty ones. Texts are told apart by a hash of 128 bits.

    A conversation is rows of up to ``segment`` symbols; the grammar is learnt from all of them, is of at most ``rules`` rules, and is all that tasks are sent. Positions are
    dealt by ranges, so that a conversation with any share of all rows is numbered in many tasks; its symbols, compressed, are multiplied in order in one.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    base = turns.select(id_or_lowest("conv_id").alias("_c"), F.col("turn").cast("long").alias("_turn"), role.alias("_role"), text.alias("_text"))
    base = written(base.withColumn("_i", F.monotonically_increasing_id()), "repair-turns")
    solid = F.rtrim(F.col("_text"), F.lit(BLANKS))
    initial = F.when(F.substring("_role", 1, 1).isin("s", "u", "a"), F.substring("_role", 1, 1)).otherwise("o")
    same = [F.xxhash64("_role", "_text").alias("_h1"), F.xxhash64(F.lit(1), "_text", "_role").alias("_h2")]
    thin = base.select("_c", "_turn", "_role", F.xxhash64("_text").alias("_x"), "_i", *same, initial.alias("_init"), (solid == "").alias("_blank"), (~F.right(solid, F.lit(1)).isin(".", "!", "?")).alias("_cut"))
    placed = written(positions(thin, "_c", ["_turn", "_role", "_x", "_i"], "_pos", "repair"), "repair-placed")
    firsts = placed.groupBy("_c", "_h1", "_h2").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_k")).filter("_k > 1").drop("_k")
    told = placed.join(written(firsts, "repair-firsts"), ["_c", "_h1", "_h2"], "left")
    fault = F.when(F.col("_blank"), "blank").when(F.col("_pos") > F.col("_first"), "duplicate").when(F.col("_cut"), "truncated")
    symbol = F.when(F.col("_fault").isin("blank", "duplicate"), "x").when(F.col("_fault") == "truncated", F.upper("_init")).otherwise(F.col("_init"))
    told = told.select("_c", "_turn", "_i", "_pos", "_init", fault.alias("_fault")).withColumn("_sym", symbol)
    told = written(told, "repair-told")

    in_order = F.sort_array(F.collect_list(F.struct("_pos", "_sym", "_init")))
    joined = lambda name: F.array_join(F.transform("_rows", lambda r: r[name]), "")
    segments = told.groupBy("_c", F.floor(F.col("_pos") / segment).alias("_s")).agg(in_order.alias("_rows"))
    segments = written(segments.select("_c", "_s", joined("_sym").alias("seq"), joined("_init").alias("inits")), "repair-segments")
    strings = written(segments.groupBy("seq").agg(F.count(F.lit(1)).alias("n")), "repair-strings")
    grammar = learn_grammar(strings, rounds, rules)
    dealt = segments.withColumn("seq", compressed(F.col("seq"), grammar)).repartition("_c").sortWithinPartitions("_c", "_s")
    folded = written(dealt.mapInPandas(fold(grammar), "_c long, _s long, piece string, cost long, audit string, illegal long"), "repair-folded")

    times = lambda name: F.count(F.when(F.col("_fault") == name, 1)).alias(name)
    counts = told.groupBy("_c").agg(times("blank"), times("duplicate"), times("truncated"))
    numbers = told.select("_c", "_turn").distinct().groupBy("_c").agg(F.coalesce(F.max("_turn") - F.min("_turn") + 1 - F.count("_turn"), F.lit(0)).alias("gaps"))
    report = counts.join(numbers, "_c").join(folded.filter("_s = 0").select("_c", "illegal", "cost", "audit"), "_c")
    report = report.select(id_or_null("_c").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    each = folded.select("_c", "_s", F.posexplode(F.regexp_extract_all("piece", F.lit("((?:I.)*[KRD].(?:(?:I.)+$)?)"), F.lit(1))).alias("_k", "_edits"))
    each = each.select("_c", (F.col("_s") * segment + F.col("_k")).alias("_pos"), "_edits")
    edits = told.select("_c", "_pos", "_i").join(each, ["_c", "_pos"])
    said = base.select("_i", "_role", "_text").join(edits, "_i")
    new_role = F.when(F.col("_e").endswith("u"), "user").otherwise("assistant")
    kind = F.substring("_e", 1, 1)
    parts = said.select("_c", "_pos", "_role", "_text", F.posexplode(F.regexp_extract_all("_edits", F.lit("(..)"), F.lit(1))).alias("part", "_e")).filter(~F.col("_e").startswith("D"))
    repaired = parts.select(
        id_or_null("_c").alias("conv_id"),
        F.col("_pos").alias("position"),
        "part",
        F.when(kind == "K", F.col("_role")).otherwise(new_role).alias("role"),
        F.when(kind == "I", "").otherwise(F.col("_text")).alias("text"),
        kind.alias("edit"),
    )
    return report, repaired


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """Per conversation the SHA-256 of its repaired turns, ``role:text`` joined by newlines: _c, repaired_sha256. Turns are hashed as they stream by, in order."""

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha, done = None, None, []
        for frame in frames:
            for c, line in zip(frame["_c"], frame["_l"], strict=True):
                if sha is None or c != now:
                    if sha is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = c, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(line.encode())
            yield pd.DataFrame(done, columns=["_c", "repaired_sha256"])
            done = []
        if sha is not None:
            yield pd.DataFrame([(now, sha.hexdigest())], columns=["_c", "repaired_sha256"])

    lines = repaired.select(id_or_lowest("conv_id").alias("_c"), "position", "part", F.concat("role", F.lit(":"), "text").alias("_l"))
    return lines.repartition("_c").sortWithinPartitions("_c", "position", "part").mapInPandas(digest, "_c long, repaired_sha256 string")
