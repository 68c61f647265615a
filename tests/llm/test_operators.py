"""Small tables through every operator: results against brute force, and nulls, empty tables, repeated rows, clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import chat_format, common, components, decontaminate, license_scan, line_dedup, packing, quality, sharding, url_filter
from tracewell.llm.components import connected_components

BLANKS = " \t\n\x0b\x0c\r"
LINE = "a line that many documents hold"


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


TEXTS = [
    (1, f"{LINE}\nown one\n"),
    (2, f"  {LINE.upper()}\t\nown two"),
    (3, f"x\n{LINE}\n{LINE}"),
    (3, f"x\n{LINE}\n{LINE}"),
    (4, None),
    (5, ""),
    (None, LINE),
    (6, f"{LINE}\n\n\n"),
    (7, "short\nshort"),
]


def docs(spark, rows=TEXTS):
    return table(spark, [(d, t, "x", "en", "s") for d, t in rows], "doc_id long, text string, _h string, lang string, source string")


def test_line_dedup(spark):
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs(spark)).collect()))
    assert got == [
        (False, 1, 3, 1, "own one\n"),
        (False, 2, 2, 1, "own two"),
        (False, 3, 3, 2, "x"),
        (False, 3, 3, 2, "x"),
        (False, 4, 1, 0, ""),
        (False, 5, 1, 0, ""),
        (False, 6, 4, 0, f"{LINE}\n\n\n"),
        (False, 7, 2, 0, "short\nshort"),
        (True, 0, 1, 1, ""),
    ]
    assert line_dedup.dedup_lines(docs(spark).limit(0)).collect() == []


def test_line_dedup_keeps_positions_of_long_texts(spark):
    rng = random.Random(1)
    lines = [f"{'common' if rng.random() < 0.3 else 'own'} line number {i} of the text" for i in range(3000)]
    rows = [(9, "\n".join(lines))] + [(d, "\n".join(x for x in lines if x.startswith("common"))) for d in (10, 11)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got[9] == "\n".join(x for x in lines if x.startswith("own")) and got[10] == "" and got[11] == rows[2][1]


def test_sharding(spark):
    rows = [(i, "é" * (i % 7)) for i in range(2000)] + [(None, None), (5, "x"), (5, "x")]
    out = sharding.shard_documents(docs(spark, rows), 24).collect()
    assert len(out) == 2003 and {r.law for r in out} == {"key"}
    for shard, slots in ((s, sorted(r.slot for r in out if r.shard == s)) for s in range(24)):
        assert slots == list(range(len(slots))) and len(slots) > 40, shard
    assert all(r.grown_shard in (r.shard, 24) for r in out) and 40 < sum(r.grown_shard == 24 for r in out) < 140
    moved = {r.doc_id: r for r in out}
    assert moved[8].size == 10 and moved[8].text_crc32 == zlib.crc32("é".encode()) and moved[None].size == 8 and moved[None].text_crc32 == 0
    more = {r.doc_id: r.shard for r in sharding.shard_documents(docs(spark, rows), 25, slots=False).collect()}
    assert all(more[r.doc_id] == r.grown_shard for r in out)
    assert sharding.shard_documents(docs(spark).limit(0)).collect() == []


def test_sharding_of_odd_texts(spark):
    """Sizes and checksums of all rows, with columns named like the result's and a very long text."""
    texts = [None, "", "é", "a\n" * 2_000_000, "x" * 70_000, "\x00", "🙂 text"]
    rows = table(spark, [(i, t, "x", "x") for i, t in enumerate(texts)], "doc_id long, text string, size string, slot string")
    got = {r.doc_id: (r["size"], r.text_crc32) for r in sharding.shard_documents(rows, 3).collect()}
    assert got == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}


def spark_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_common_line_is_split(spark):
    """Where the lines to drop are too many for a broadcast, Spark splits the lines of a hot hash."""
    rows = [(i, f"{LINE}\n" * 40 + f"own line number {i} of this text\n" + f"a line that some documents hold {i // 4}") for i in range(400)]
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1"}
    old = {k: spark.conf.get(k) for k in small}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        data = docs(spark, rows).repartition(8)
        assert "skew=true" in spark_plan(line_dedup.dedup_lines(data).select("doc_id", "n_dropped"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_jump_is_the_published_function():
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    keys = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    assert sharding.jump(keys, 1000).tolist() == [jump(int(k), 1000) for k in keys]


def test_urls(spark):
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
    urls = ["http://WWW.Example.com/en/1", "http://a.example.com/en/1?x=/", "http://b.com", "http://b.com/q", "http://net/es/", "x.net/es/", None, "http://bad.org/a", "http://good.org/b#c", "://h.net/es/x#y"]
    pages = table(spark, [(i, u, "h", 1.0) for i, u in enumerate(urls)] + [(100 + i, f"http://bad.org/{i}", "h", 1.0) for i in range(40)], "page_id long, url string, host string, mean double")
    labels = table(spark, [(100 + i, 0, None) for i in range(40)] + [(8, 1, 0), (8, 1, 0), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, labels, rules).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[2][:3] == ("b.com", "", None) and got[3][2:] == ("com/", "allow")
    assert got[4] == ("net", "/es/", "net/es/", "block") and got[5][:2] == ("", "") and got[6][:2] == ("", "")
    assert got[7] == ("bad.org", "/a", None, "block") and got[8][:3] == ("good.org", "/b", None) and got[9] == ("h.net", "/es/x", "net/es/", "block")
    assert url_filter.judge_urls(pages.limit(0), labels.limit(0), rules).collect() == []
    domain, suffix = (F.coalesce(c, F.lit("")) for c in url_filter.host_levels(F.col("h")))
    hosts = table(spark, [("a.b.co.uk:80",), ("b.com",), ("x.y.z.com",), ("",)], "h string")
    assert [tuple(r) for r in hosts.select(domain, suffix).collect()] == [("b.co.uk", "co.uk"), ("b.com", "com"), ("z.com", "com"), ("", "")]


def brute_hits(text, items, size=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = find(text), set(), set()
    for item, said in items:
        own = find(said)
        n = min(size, len(own))
        for w in {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) == w:
                    hit |= set(range(i, i + n))
                    found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [4 << 20, 60])
def test_decontaminate(spark, block):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "a", "Of", "x1", "é", "run", "w"]) + rng.choice(["", "s", "t"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([12, 25, 3, 1, 10, 9])] + [(20, "zz"), (21, ""), (22, "!!"), (0, "another text of item nought")]
    rows = [(i, " ".join([word() for _ in range(30)] + [rng.choice(items)[1].upper()] + [word() + rng.choice([",", "\n", "-"]) for _ in range(30)])) for i in range(25)]
    rows += [(90, None), (91, ""), (92, "zz"), (92, "zz"), (93, "another TEXT of item\tnought")]
    bench = table(spark, [(i, t, "x") for i, t in items] + [(None, "zz", "x"), (30, None, "x")], "item_id long, text string, n_words string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.items, r.items_sha256) for r in decontaminate.decontaminate(docs(spark, rows), bench, block_bytes=block).collect()]
    expected = [(d, *brute_hits(t, items)) for d, t in rows]
    expected = [(*x, hashlib.sha256(",".join(sorted(map(str, x[3]))).encode()).hexdigest()) for x in expected]
    assert sorted(got, key=str) == sorted(expected, key=str) and sum(x[2] for x in expected) > 150
    assert decontaminate.decontaminate(docs(spark).limit(0), bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs(spark), bench.limit(0)).collect())


def test_packing(spark):
    rng = random.Random(4)
    texts = ["", None, "Hello  world's\n\n 12 über", "<|endoftext|> is text", "a" * 3000, " \t ", "日本語 text 🙂"]
    texts += [" ".join(rng.choice(["The", "model", "läuft", "x=1;", "\n"]) for _ in range(rng.randint(1, 2500))) for _ in range(12)]
    rows = list(enumerate(texts)) + [(2, texts[2]), (None, "q")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.pack_documents(docs(spark, rows).withColumn("ids", F.lit(1)), path).collect()
    tokenizer = Tokenizer.from_file(path)
    assert sorted(r.sequence_id for r in out) == list(range(len(out)))
    assert [r.length for r in sorted(out, key=lambda r: r.sequence_id)] == sorted((r.length for r in out), reverse=True)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 1024 and r.offset == 0 for r in out)
    for doc, text in enumerate(texts):
        own = sorted((r for r in out if r.doc_id == doc), key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in own][:: 2 if doc == 2 else 1])
        assert ids.tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], doc
        assert {r.doc_tokens for r in own} == {len(ids)}
    assert packing.pack_documents(docs(spark).limit(0), path).collect() == []


@pytest.mark.parametrize("text", ["\n" * 1_000_000 + "x", " " * 1_000_000 + "x", "word One  two\tthree's " * 60_000, "日本語" * 100_000])
def test_packing_of_very_long_texts(spark, text):
    """White space without end, and texts that are encoded in parts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.pack_documents(docs(spark, [(1, text)]), path).orderBy("start").collect()
    ids = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in out])
    assert ids.tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 0]


def test_units_of_text_have_the_ids_of_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encode = Tokenizer.from_file(path), packing.Encoder(path)
    assert encode.units
    rng = random.Random(31)
    signs = ["a", "Word", " ", "  ", "\n", "\t", "'s", "'", ",", "9", "é", "ß", "日本", "\u00a0", "\u180e", "\u2003", "\x1c", "🙂", "<|endoftext|>", "_", "\x00", " x", ".", "×", "÷", "É", " é", " (", "ж"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", " ", " a", "a "]
    column = pa.array(texts)
    for lo, _, data, offsets in packing.text_chunks(column, 1 << 12):
        ids, counts = encode(data, offsets, 0)
        for text, part in zip(texts[lo:], np.split(ids, np.cumsum(counts)[:-1]), strict=False):
            assert part.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0], text


CHAT = [
    (1, 0, "system", "Be brief."),
    (1, 1, "user", "what is </s> and [INST]? \\ <|x|> <</SYS>>"),
    (1, 2, "assistant", "[/INST] a \\</s> mark\n<|end|>\n"),
    (1, 3, "user", "word " * 300),
    (1, 4, "assistant", "reply " * 400),
    (1, 5, "user", "and?"),
    (1, 5, "user", "and?"),
    (1, 6, "assistant", ""),
    (2, None, None, None),
    (None, 0, "assistant", "é🙂"),
    (3, 0, "user", "long " * 3000),
    (3, 1, "assistant", "ok"),
    *[(4, i, "assistant" if i % 2 else "user", f"turn {i} " + "word " * 30) for i in range(90)],
    *[(5, i, "assistant" if i % 2 else "user", "word " * (900 if i == 50 else 30)) for i in range(101)],
]


def test_chat(spark):
    turns = table(spark, [(*r, "x") for r in CHAT], "conv_id long, turn long, role string, text string, window string")
    windows = chat_format.format_conversations(turns)
    got = {r.conv_id: r for r in chat_format.read_back(windows).collect()}
    for conv in {r[0] for r in CHAT}:
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in CHAT if c == conv))
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    tokens = lambda text: len(re.findall(chat_format.TOKEN, text))
    texts = [r for r in windows.collect() if r.conv_id == 1]
    assert len(texts) > 1 and all("Be brief." in r.text for r in texts) and all(tokens(r.text) < 1400 for r in texts)
    assert all(not any(c in chat_format.unescaped(r.text[s.start : s.end]) and c in r.text[s.start : s.end] for c in chat_format.CONTROLS) for r in texts for s in r.loss)
    many = [r for r in windows.collect() if r.conv_id == 4]
    assert len(many) > 2 and {r.n_context for r in many} == {0, 2} and sum(r.n_turns for r in many) == 90
    assert all(tokens(r.text) <= 1024 + 90 * 8 for r in many)
    # a turn near the budget does not take its neighbours apart
    mixed = [r for r in windows.collect() if r.conv_id == 5]
    assert sum(r.n_turns for r in mixed) == 101 and len(mixed) < 15 and any(r.n_turns == 1 for r in mixed)
    assert chat_format.read_back(chat_format.format_conversations(turns.limit(0))).collect() == []


def test_chat_sums_over_ranges_and_other_counts(spark, monkeypatch):
    """One conversation in many ranges, and tokens by another count."""
    monkeypatch.setattr(chat_format, "ROWS_A_RANGE", 20)
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(400)] + [(c, 0, "user", "x") for c in range(2, 30)]
    data = table(spark, rows, "conv_id long, turn long, role string, text string")
    thin = data.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_turn"), F.col("role").alias("_role"), F.lit(0).alias("_x"), F.monotonically_increasing_id().alias("_i"), F.lit(3).cast("long").alias("_tok"))
    got = sorted((r._c, r._pos, r._before) for r in chat_format.running(thin).collect())
    assert got == sorted([(1, i + 1, 3 * i) for i in range(400)] + [(c, 1, 0) for c in range(2, 30)])
    windows = chat_format.format_conversations(data, budget=24, history_turns=0, history_tokens=0, count_tokens=lambda text: F.lit(2)).collect()
    assert {r.n_turns for r in windows if r.conv_id == 1} == {2} and sum(r.n_turns for r in windows) == 428


def filler(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(4)) for _ in range(n))


def test_licenses(spark):
    """Every template in texts of other words; rows repeated, columns with the results' names, a very long text."""
    rng = random.Random(6)
    rows, expected = [], Counter()
    for i in range(300):
        name, notice = license_scan.TEMPLATES[i % len(license_scan.TEMPLATES)]
        rows.append((i, f"{filler(rng, rng.randint(0, 40))} {notice.upper() if i % 2 else notice} {filler(rng, rng.randint(0, 40))}"))
        expected[(i, name)] += 1
    rows += [(900, None), (901, ""), (902, filler(rng, 300)), (903, "licensed under"), (904, "?!")]
    rows += [(905, f"{filler(rng, 100_000)} {license_scan.TEMPLATES[0][1]} {filler(rng, 100_000)}"), (906, license_scan.TEMPLATES[1][1]), (906, license_scan.TEMPLATES[1][1])]
    data = table(spark, [(d, t, "x", 0.0, 1) for d, t in rows], "doc_id long, text string, license string, containment double, _row int")
    out = license_scan.scan_licenses(data).collect()
    got = {(r.doc_id, r.license): r.containment for r in out}
    assert not {d for d, _ in got} & {900, 901, 902, 903, 904} and {r._row for r in out} == {1}
    assert all(got.get(k) == 1.0 for k in expected) and [r.license for r in out if r.doc_id == 906] == ["Apache-2.0"] * 2
    assert [r.word > 99_990 for r in out if r.doc_id == 905] == [True]
    assert license_scan.scan_licenses(data.limit(0)).collect() == []
    assert len(license_scan.TEMPLATES) >= 60


def test_minhash_of_windows_retrieves_nearly_all_places(spark):
    """The share of places that no window shows is under what the settings promise, and single windows hide some."""
    rng = random.Random(7)
    data = license_scan.with_shingles(table(spark, [(filler(rng, 3_000),) for _ in range(20)], "text string"))
    counted = data.withColumn("_p", F.sequence(F.lit(0), F.size("_s") - 1)).agg(F.sum(F.size("_p")).alias("n"), F.sum(F.size(license_scan.shown(F.col("_p")))).alias("k")).first()
    assert 0 < 1 - counted.k / counted.n < 0.002


def test_license_of_which_words_are_changed(spark):
    """Containment is exact, and those of 0.8 or more are found."""
    rng = random.Random(8)
    notice = max((x for x in license_scan.TEMPLATES if x[0] == "MIT"), key=lambda x: len(x[1]))[1]
    rows = []
    for i in range(120):
        words = notice.split(" ")
        for _ in range(i % 9):
            words[rng.randrange(len(words))] = "other"
        rows.append((i, f"{filler(rng, 20)} {' '.join(words)} {filler(rng, 20)}"))
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    five = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    held = five(find(notice))
    share = {i: len(five(find(t)) & held) / len(held) for i, t in rows}
    got = {r.doc_id: r.containment for r in license_scan.scan_licenses(docs(spark, rows), [("MIT", notice)]).collect()}
    assert got == pytest.approx({i: x for i, x in share.items() if x >= 0.8}) and 20 < len(got) < 120


def test_license_neighbours_have_their_own_names(spark):
    gnu = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    bsd = "Redistributions in binary form must reproduce the above copyright notice in the documentation and/or other materials provided with the distribution. "
    third = "3. Neither the name of Example nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    end = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS 'AS IS'"
    said = [
        (gnu.format("", 2), {"GPL", "GPL-2.0"}), (gnu.format("", 3), {"GPL", "GPL-3.0"}), (gnu.format("Affero ", 3), {"AGPL-3.0"}),
        (gnu.format("Lesser ", "2.1"), {"LGPL-2.1"}), (gnu.format("Lesser ", 3), {"LGPL-3.0"}),
        ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", {"GPL-2.0"}), ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", {"LGPL-3.0"}),
        (bsd + end, {"BSD-2-Clause"}), (bsd + third + end, {"BSD-3-Clause"}),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that", {"ISC"}),
    ]
    got = {i: set() for i in range(len(said))}
    for r in license_scan.scan_licenses(docs(spark, [(i, t) for i, (t, _) in enumerate(said)])).collect():
        got[r.doc_id].add(r.license)
    assert got == {i: names for i, (_, names) in enumerate(said)}


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9)))
    rows = [(i, " ".join(word() + rng.choice(["", ",", ".\n"]) for _ in range(rng.randint(60, 400)))) for i in range(150)]
    junk = [(500 + i, " ".join(word() + "###" for _ in range(120))) for i in range(12)]
    odd = [(600, None), (601, ""), (602, "a b a b a b c"), (603, "x\nx\n \n\nx"), (604, ("one two three " * 40)), (605, "\x0b\x0c a"), (606, "a a a")]
    extra = [(700, " ".join(rng.choice("ab") for _ in range(90))), (700, " ".join(rng.choice("ab") for _ in range(90)))]
    every = rows + junk + odd + extra
    out = quality.judge_quality(docs(spark, every)).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out))
    assert got == sorted((d, *brute_statistics(t)) for d, t in every)
    by = {r.doc_id: r for r in out}
    assert all(by[d].base_failed == (by[d].n_words < 50 or 100 * by[d].n_repeat_words > 50 * by[d].n_words) for d, _ in every)
    assert all(by[d].kept for d, _ in rows) and not any(by[d].kept for d, _ in junk) and not by[600].kept
    assert quality.judge_quality(docs(spark).limit(0)).collect() == []


def test_quality_judges_each_statistic_alone(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 7)))
    clean = [(i, " ".join(word() for _ in range(rng.randint(150, 250)))) for i in range(120)]
    odd = {
        500: " ".join(word() + " |" * (i % 3 == 0) for i in range(200)),  # symbols: 6 %
        501: " ".join([word() for _ in range(110)] + ["one", "two", "three"] * 25),  # repeats: 40 % of the words
        502: " ".join(word() for _ in range(150)) + "\nx y" * 30,  # lines
        503: " ".join(word() + word() + word() for _ in range(200)),  # long words
    }
    # a statistic that a few clean texts have a little of
    some = [(400 + i, " ".join([word() for _ in range(195)] + ["one two three", "one two three"])) for i in range(3)]
    got = {r.doc_id: r for r in quality.judge_quality(docs(spark, clean + some + list(odd.items()))).collect()}
    assert not any(got[d].base_failed for d in odd) and not any(got[d].kept for d in odd)
    assert all(got[d].kept for d, _ in clean + some)


def brute_quantile(x, q):
    return np.sort(x)[max(int(np.ceil(q * len(x))) - 1, 0)]


def brute_distance(x, centre, cov):
    away = x - centre
    return np.einsum("ij,ij->i", away, np.linalg.solve(cov, away.T).T)


def brute_mcd(x, least, share=0.75):
    """Centre and scaled covariance of one group's rows."""
    ridge = np.diag(np.square(least))
    moments = lambda rows: (rows.mean(axis=0), np.atleast_2d(np.cov(rows.T, bias=True)) + ridge)
    scale = lambda d2: max(brute_quantile(d2, 0.5) / quality.CHI2_MEDIAN, 1.0)
    middle = np.array([brute_quantile(c, 0.5) for c in x.T])
    away = np.abs(x - middle)
    z = np.square(away / (1.4826 * np.array([brute_quantile(c, 0.5) for c in away.T]) + least))
    best = None
    for d2 in (z.sum(axis=1), z.max(axis=1)):
        for _ in range(3):
            fit = moments(x[d2 <= brute_quantile(d2, share)])
            d2 = brute_distance(x, *fit)
        if best is None or np.linalg.slogdet(fit[1])[1] < best[0]:
            best = np.linalg.slogdet(fit[1])[1], d2
    centre, cov = moments(x[best[1] <= quality.CHI2_INNER * scale(best[1])])
    return centre, cov * scale(brute_distance(x, centre, cov))


def brute_verdicts(rows, prior=40):
    """d2 by doc_id of (doc_id, text, lang, source), by the same rules in plain loops."""
    x, groups = {}, {}
    for d, t, lang, source in rows:
        n, chars, symbols, lines, repeats = brute_statistics(t)
        if n >= 50 and 100 * repeats <= 50 * n:
            x[d] = np.array([np.log1p(n), np.log((chars + 1) / (n + 1)), *[np.sqrt(a / b) for a, b in ((symbols, chars + 1), (repeats, n + 1), (lines, n + 1))]])
            groups[d] = (lang, source)
    every = np.array(list(x.values()))
    words = np.expm1(brute_quantile(every[:, 0], 0.5))
    least = np.array(quality.least_deviations(words, np.exp(brute_quantile(every[:, 1], 0.5)) * (words + 1) - 1))

    def mixed(own, parent, apart=1):
        n, (m, c), (pm, pc) = len(own), brute_mcd(own, least), parent
        w = n / (n + prior)
        return w * m + (1 - w) * pm, w * c + (1 - w) * pc + apart * w * (1 - w) * np.outer(m - pm, m - pm)

    plain = every.mean(axis=0), np.cov(every.T, bias=True) + np.diag(np.square(least))
    whole, out = mixed(every, plain), {}
    for lang in {g[0] for g in groups.values()}:
        language = mixed(np.array([x[d] for d in x if groups[d][0] == lang]), whole)
        for source in {g[1] for g in groups.values() if g[0] == lang}:
            held = [d for d in x if groups[d] == (lang, source)]
            fit = mixed(np.array([x[d] for d in held]), language, 0)
            out |= dict(zip(held, brute_distance(np.array([x[d] for d in held]), *fit), strict=True))
    return out


def test_quality_is_the_brute_force_fit(spark):
    """Groups of every size, from one row up, null languages and sources, a whole table of few rows."""
    rng = random.Random(13)
    text = lambda mark, n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 7))) + mark * (rng.random() < 0.9) for _ in range(n))
    rows = [(i, text("", rng.randint(60, 300)) + "\nx y" * (i % 9 == 0), ["en", "en", "en", "de", None][i % 5], ["a", "b", "c", None][i % 4 if i % 7 else 0]) for i in range(260)]
    rows += [(300 + i, text("##", 200), "en", "a") for i in range(6)] + [(400, text("#", 100), "fr", "z"), (401, text("", 100), "fr", "y"), (402, "short", "fr", "y")]
    table_of = lambda rows: table(spark, rows, "doc_id long, text string, lang string, source string")
    for part in (rows, rows[:7]):
        got = {r.doc_id: r for r in quality.judge_quality(table_of(part)).collect()}
        expected = brute_verdicts(part)
        assert {d for d, r in got.items() if r.d2 is not None} == set(expected)
        for d, d2 in expected.items():
            assert got[d].d2 == pytest.approx(d2, rel=1e-6) and got[d].kept == (d2 <= quality.CHI2_CUTOFF)
    assert {d for d, r in {r.doc_id: r for r in quality.judge_quality(table_of(rows)).collect()}.items() if not r.kept} == {300, 301, 302, 303, 304, 305, 400, 402}


def test_quality_of_a_very_long_text_and_clashing_names(spark):
    rng = random.Random(14)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300_000))
    rows = table(spark, [(1, long, "en", "s", 1, 1), (2, long[:900], "en", "s", 1, 1)], "doc_id long, text string, lang string, source string, n_words int, d2 int")
    got = {r.doc_id: (r.n_words, r.n_repeat_words, r.base_failed) for r in quality.judge_quality(rows).collect()}
    assert got == {1: (300_000, brute_statistics(long)[4], False), 2: (129, 0, False)}


def test_quality_joins_by_broadcast(spark):
    """No row meets its group's fit by a shuffle on the group."""
    rows = [(i, " ".join(f"w{(i * 7 + k) % 89}{k % 13}" for k in range(60 + i % 40)), "en", "s") for i in range(60)]
    out = quality.judge_quality(table(spark, rows, "doc_id long, text string, lang string, source string"))
    assert "SortMergeJoin" not in spark_plan(out) and "BroadcastHashJoin" in spark_plan(out)


def test_quality_takes_few_queries_of_the_driver(spark, monkeypatch):
    """Tables whose groups fit a bin are not binned first, and no order statistic is taken twice."""
    names, written = [], quality.written
    monkeypatch.setattr(quality, "written", lambda df, name: names.append(name) or written(df, name))
    rows = [(i, " ".join(f"w{(i * 7 + k) % 89}{k % 13}" for k in range(60 + i % 40)), "en", "s") for i in range(60)]
    quality.judge_quality(table(spark, rows, "doc_id long, text string, lang string, source string")).collect()
    assert not [n for n in names if n.endswith("-bins")] and len(names) <= 18


def test_robust_fit_resists_outliers(spark):
    rng = np.random.default_rng(8)
    inner = rng.normal(0, 1, (800, 5))
    outer = rng.normal(12, 0.5, (150, 5))
    rows = [("g", *map(float, x)) for x in np.vstack([inner, outer])]
    data = table(spark, rows, "k string, x0 double, x1 double, x2 double, x3 double, x4 double")
    fit = quality.fit_mcd(data, ["k"], [0.01] * 5).first()
    assert fit.n == 950 and all(abs(fit[f"m{i}"]) < 0.3 for i in range(5))
    distance = quality.with_distance(data, quality.fit_mcd(data, ["k"], [0.01] * 5), ["k"]).collect()
    assert sum(r.x0 > 6 for r in distance) == 150 and all((r.d2 > 100) == (r.x0 > 6) for r in distance)


@pytest.mark.parametrize("held", [500_000, 7])
def test_components(spark, monkeypatch, held):
    """With seven edges a task, the tasks' stars have to be joined by rounds."""
    monkeypatch.setattr(components, "EDGES_A_TASK", held)
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = {r.id: r.root for r in connected_components(table(spark, edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e if x is not None}
    for _ in root:
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] not in (None, e[1]) for e in edges)}
    assert connected_components(table(spark, [], "a long, b long")).collect() == []


def test_quality_does_not_depend_on_how_rows_are_dealt(spark):
    """A group of over 20,000 rows, in 1, 7 and 64 partitions; and order statistics of many ties are exact."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(21_000, 5)) * [1, 0.2, 0.01, 0.1, 0.05] + [4, 1.6, 0.05, 0.2, 0]
    x[:, 2:] = np.maximum(x[:, 2:], 0)
    values = [("g" if i % 50 else "small", *map(float, r)) for i, r in enumerate(x)]
    rows = spark.createDataFrame(values, "k string, x0 double, x1 double, x2 double, x3 double, x4 double").withColumn("i", F.monotonically_increasing_id())
    found = []
    rows = common.written(rows, "test")
    for parts in (1, 7, 64):
        dealt = common.written(rows.repartition(parts), "test")
        fit = quality.fit_mcd(dealt, ["k"], [0.01] * 5)
        found.append(np.array([r.d2 for r in quality.with_distance(dealt, fit, ["k"]).orderBy("i").collect()]))
    assert np.allclose(found[0], found[1], rtol=1e-9, atol=0) and np.allclose(found[0], found[2], rtol=1e-9, atol=0)
    for share in (0.5, 0.75):
        got = {r.k: (r.a, r.b) for r in quality.order_statistics(rows, ["k"], {"a": F.col("x1"), "b": F.col("x4")}, share, "test", True, 50).collect()}
        for k in ("g", "small"):
            own = np.sort(np.array([v[1:] for v in values if v[0] == k]), axis=0)
            at = int(np.ceil(share * len(own))) - 1
            assert got[k] == (own[at, 1], own[at, 4])


def test_chat_roles_of_every_kind_are_read_back(spark):
    rng = np.random.default_rng(8)
    pieces = ["<|", "|>", "\n", "end", ">", "|", "\\", "<", "user", "</s>", "é", ""]
    roles = [">\nfoo", "end", "|>\n", "<|end|>\n", "\\", "a|", "", None] + ["".join(rng.choice(pieces, rng.integers(0, 5))) for _ in range(60)]
    rows = [(i, t, role, f"text {t} " + "".join(rng.choice(pieces, 3))) for i, role in enumerate(roles) for t in range(2)]
    windows = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {r.conv_id: (r.n_turns, r.turns_sha256) for r in chat_format.read_back(windows).collect()}
    for i, role in enumerate(roles):
        own = "".join(f"{role or ''}\n{text}\n" for c, _, _, text in rows if c == i)
        assert found[i] == (2, hashlib.sha256(own.encode()).hexdigest()), role
