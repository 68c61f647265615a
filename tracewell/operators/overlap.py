"""Overlaps of a context's sources: where one continues another of its document, what both hold is cut from the later one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.overlaps import suffix_prefix

LEAST = 4
#: Sources that are handed on at once.
ROWS = 500
_KEYS = ["context_id", "document_id", "source_id", "ordinal", "start_line", "end_line"]


def trim_overlaps(sources: DataFrame, least: int = LEAST) -> DataFrame:
    """Each source with what an earlier one of its context and document ends with cut from its beginning.

    In: context_id, document_id, source_id, ordinal, start_line, end_line, content. Out: the same with content, trimmed_chars, trimmed_from (the last source that it was cut against) and pairs: an array of (left_id, chars, bytes),
    one for each cut.

    A source is held against those before it (by start line, ordinal and id) whose lines it continues: it starts inside them or on the next line, and does not end before them. Those were cut before. The longest end of
    one that the other begins with is cut, from ``least`` characters on, unless nothing would be left. Sources without lines are never cut. A null content is empty. Repeated rows continue each other, and since nothing would be
    left, stay. An empty table gives an empty table.

    A document's sources stream by in order of their lines, and only those that reach the present line are held: sources that are no neighbours are never compared.
    """
    kinds = dict(sources.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, open_ = None, []  # (start, end, id, content) of the sources that may still be continued
        # few rows at a time: rows, their results and these as a frame are there at once
        for frame in (whole.iloc[i : i + ROWS] for whole in frames for i in range(0, len(whole), ROWS)):
            out = []
            for context, document, source, ordinal, start, end, content in frame[[*_KEYS, "content"]].itertuples(index=False, name=None):
                # a null key comes as None or NaN, which differs from itself
                key = tuple(None if pd.isna(x) else x for x in (context, document))
                if key != now:
                    now, open_ = key, []
                cut, last, pairs = 0, None, []
                if not (pd.isna(start) or pd.isna(end)):
                    open_ = [x for x in open_ if x[1] + 1 >= start]
                    for s, e, left, held in open_:
                        if s <= start and e <= end:
                            chars = suffix_prefix(held, content, least)
                            if 0 < chars < len(content):
                                pairs.append({"left_id": left, "chars": chars, "bytes": len(content[:chars].encode())})
                                content, cut, last = content[chars:], cut + chars, left
                    open_.append((start, end, source, content))
                out.append((*key, source, ordinal, start, end, content, cut, last, pairs))
            yield pd.DataFrame(out, columns=[*_KEYS, "content", "trimmed_chars", "trimmed_from", "pairs"]).astype({"start_line": "Int64", "end_line": "Int64", "ordinal": "Int64"})

    rows = sources.select(*_KEYS[:3], *[F.col(x).cast("long").alias(x) for x in _KEYS[3:]], F.coalesce("content", F.lit("")).alias("content"))
    dealt = rows.repartition("context_id", "document_id").sortWithinPartitions("context_id", "document_id", F.coalesce("start_line", F.lit(0)), F.coalesce("ordinal", F.lit(0)), "source_id")
    kept = ", ".join(f"{x} {kinds[x]}" for x in _KEYS[:3]) + ", ordinal long, start_line long, end_line long"
    source = kinds["source_id"]
    return dealt.mapInPandas(run, f"{kept}, content string, trimmed_chars long, trimmed_from {source}, pairs array<struct<left_id: {source}, chars: bigint, bytes: bigint>>")


def overlap_report(trimmed: DataFrame) -> DataFrame:
    """Of each context: sources, cut pairs, and the characters, UTF-8 bytes and estimated tokens that are sent once instead of twice. In: the rows of trim_overlaps()."""
    total = lambda f: F.aggregate("pairs", F.lit(0).cast("long"), lambda a, p: a + f(p))
    sized = trimmed.select("context_id", F.size("pairs").alias("n"), total(lambda p: p["chars"]).alias("chars"), total(lambda p: p["bytes"]).alias("bytes"), total(lambda p: F.floor((p["chars"] + 3) / 4)).alias("tokens"))
    return sized.groupBy("context_id").agg(
        F.count(F.lit(1)).alias("sources"), F.sum("n").alias("pairs"), F.sum("chars").alias("overlap_chars"), F.sum("bytes").alias("overlap_bytes"), F.sum("tokens").alias("overlap_tokens")
    )


def line_pieces(docs: DataFrame, lines: int, step: int) -> DataFrame:
    """Texts in pieces of ``lines`` lines, a new one every ``step`` lines: document_id, ordinal, start_line, end_line, content. In: document_id, text. Null is one empty line."""
    rows = docs.select("document_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("_l"))
    pieces = F.greatest(F.lit(1), F.ceil((F.size("_l") - (lines - step)) / step)).cast("int")
    each = rows.select("document_id", "_l", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("ordinal"))
    end = F.least(F.col("ordinal") * step + lines, F.size("_l"))
    return each.select(
        "document_id", "ordinal", (F.col("ordinal") * step + 1).alias("start_line"), end.alias("end_line"), F.array_join(F.slice("_l", F.col("ordinal") * step + 1, F.lit(lines)), "\n").alias("content")
    )
