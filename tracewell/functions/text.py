"""Scalar functions over texts, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[A-Za-z_][A-Za-z0-9_]*|\d+"


def estimate_tokens(text: Column) -> Column:
    """A quarter of the code points, rounded up, and 1 at least."""
    return F.greatest(F.lit(1), F.floor((F.char_length(text) + 3) / 4)).cast("long")


def normalize_newlines(text: Column) -> Column:
    """One leading byte-order mark removed, and every line ending a newline."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def strip(text: Column) -> Column:
    """White space of every kind cut at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def snippet(text: Column, most: int = 240) -> Column:
    """White space collapsed, cut to ``most`` characters with an ellipsis."""
    flat = F.btrim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 3)), F.lit("..."))).otherwise(flat)


def truncate_to_tokens(text: Column, tokens: Column) -> Column:
    """A text that fits an estimate of ``tokens``, with an ellipsis if it was cut."""
    room = tokens * 4
    cut = F.concat(F.rtrim(F.substring(text, F.lit(1), F.greatest(room - 3, F.lit(0)).cast("int"))), F.lit("..."))
    return F.when(F.char_length(text) <= room, text).otherwise(cut)


def word_tokens(text: Column) -> Column:
    """Distinct identifiers and numbers of the lower-cased text, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1)))


def keyword_score(text: Column, tokens: list[str]) -> Column:
    """Share of the tokens that the text contains, and up to a quarter for how often it contains the first; 1 at most."""
    if not tokens:
        return F.lit(0.0)
    low = F.lower(text)
    matched = reduce(lambda a, b: a + b, [F.contains(low, F.lit(t)).cast("int") for t in tokens])
    first = (F.char_length(low) - F.char_length(F.replace(low, F.lit(tokens[0])))) / F.lit(len(tokens[0]))
    score = F.least(F.lit(1.0), matched / F.lit(float(len(tokens))) + F.least(F.lit(0.25), first / F.lit(20.0)))
    return F.when(matched > 0, score).otherwise(F.lit(0.0))


def fold_accents(text: Column) -> Column:
    """Lower case, with the accents of Spanish vowels and of n removed."""
    return F.translate(F.lower(text), "áéíóúñ", "aeioun")


def important_tokens(text: Column, stopwords: list[str], least: int = 4) -> Column:
    """Distinct folded tokens of ``least`` characters or with an underscore, that are no stopwords or citation marks."""
    tokens = F.array_distinct(F.regexp_extract_all(fold_accents(text), F.lit(r"([a-z_][a-z0-9_]*)"), F.lit(1)))
    kept = F.filter(tokens, lambda t: ((F.char_length(t) >= least) | F.contains(t, F.lit("_"))) & ~t.rlike(r"^f\d+$"))
    return F.array_except(kept, F.array(*map(F.lit, stopwords)) if stopwords else F.array().cast("array<string>"))


def symbol_name(name: Column) -> Column:
    """Parts between dots, unquoted, trimmed, lower-cased, without empty ones."""
    parts = F.transform(F.split(name, r"\."), lambda p: F.lower(F.regexp_replace(F.btrim(p), '^"|"$|^`|`$|^\\[|\\]$', "")))
    # most names are so already
    return F.when(F.translate(name, "abcdefghijklmnopqrstuvwxyz0123456789_", "") == "", name).otherwise(F.array_join(F.filter(parts, lambda p: p != ""), "."))


def citations(text: Column) -> Column:
    """Source ids of marks like [F3], distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(F\d+)\]"), F.lit(1)))


def claims(text: Column) -> Column:
    """Sentences and lines of an answer."""
    parts = F.split(text, r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda p: strip(p)), lambda p: p != "")


def smoothed_idf(records: Column, frequency: Column) -> Column:
    """Rarity from 0 to 1: 1 for a concept of one record, falling with the logarithm of its frequency."""
    top = F.log((records + 1.0) / F.lit(1.5))
    value = F.log((records + 1.0) / (frequency + 0.5)) / top
    return F.when((records <= 1) | (frequency <= 1), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def json_or_empty(text: Column) -> Column:
    """A map of a JSON object's values as strings, empty if it can't be read."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def deterministic_id(*parts: Column) -> Column:
    """A SHA-256 over the parts as a JSON array: equal parts, equal id."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256)


#: How an answer says that there is not enough evidence, and the verbs whose negation can contradict a context.
INSUFFICIENT = "evidencia insuficiente"
NEGATED = ("es", "usa", "utiliza")


def folded_words(text: Column) -> Column:
    """Runs of letters a-z, digits and underscores of the folded text, in order."""
    return F.regexp_extract_all(fold_accents(text), F.lit(r"([a-z0-9_]+)"), F.lit(1))


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"\[F\d+\]", " ")


def cited_claims(text: Column) -> Column:
    """The claims of an answer with a citation: an array of (claim, sources), the sources sorted."""
    trimmed = F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda p: F.btrim(p, F.lit(" -\t")))
    with_sources = F.transform(trimmed, lambda p: F.struct(p.alias("claim"), F.sort_array(citations(p)).alias("sources")))
    return F.filter(with_sources, lambda c: F.size(c["sources"]) > 0)


def uncited_blocks(text: Column, stopwords: list[str]) -> Column:
    """Paragraphs and list items of an answer that say something and cite nothing. Fenced code, headings and blank lines end a block and are none."""
    no_code = F.regexp_replace(text, r"(?m)^[ \t]*```[\s\S]*?(?:^[ \t]*```[^\n]*$|\z)", "\n\n")
    no_heads = F.regexp_replace(no_code, r"(?m)^[ \t]*#{1,6}[ \t]+.*$", "\n\n")
    items = F.regexp_replace(no_heads, r"(?m)^[ \t]*((?:[-*+]|\d+[.)])[ \t]+)", "\n\n$1")
    blocks = F.transform(F.split(items, r"\n[ \t]*\n\s*"), lambda b: strip(F.regexp_replace(b, r"\s*\n\s*", " ")))
    return F.filter(blocks, lambda b: ~b.rlike(r"\[F\d+\]") & (F.size(important_tokens(strip_citations(b), stopwords)) > 0))
