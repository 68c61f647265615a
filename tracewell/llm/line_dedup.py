"""Line dedup: explode normalised lines, hash them, count distinct documents, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import BLANKS, ascii_lower, id_or_lowest, id_or_null, written


def line_key(line: Column) -> Column:
    """A line's key: blanks stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop every line whose key is in at least ``min_docs`` documents, except in the largest doc_id that holds it.

    In: doc_id, text (others are ignored). Out: a row per input row with doc_id, n_lines, n_dropped and text, the kept
    lines joined by newlines (an empty string if none is kept), and the input columns named in ``keep``.

    Null or empty text is one empty line. Keys under ``min_chars`` code points always stay. A null doc_id counts as one
    document, smaller than all others. Repeated rows (same id and text) count once and get equal results; rows of one
    id with different texts count as one document and are each cut by themselves. An empty table gives an empty table.

    Only hashes travel: a line is an id, a position and a 128-bit hash. A line that a third of all documents hold is
    counted after map-side aggregation. The hashes to drop are written, so that they are a bare side of the join that brings them back: Spark broadcasts them where they are
    small, and beyond that splits the lines of a hot hash over tasks. Texts are shuffled once, to meet their own flags.
    """
    base = docs.select(
        id_or_lowest("doc_id").alias("_d"),
        F.coalesce(F.col("text"), F.lit("")).alias("_t"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep],
    ).withColumn("_v", F.xxhash64("_t"))
    exploded = base.select("_d", "_v", F.posexplode(F.split("_t", "\n", -1)).alias("_p", "_l"))
    keyed = exploded.withColumn("_k", line_key(F.col("_l"))).filter(F.char_length("_k") >= min_chars)
    lines = keyed.select("_d", "_v", "_p", F.xxhash64("_k").alias("_h"), F.xxhash64(F.lit(1), "_k").alias("_h2"))
    held = lines.groupBy("_h", "_h2", "_d").agg(F.lit(1).alias("_one"))
    common = (
        held.groupBy("_h", "_h2")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_d").alias("_last"))
        .filter(F.col("_n") >= min_docs)
    )
    cut = (
        lines.join(written(common, "lines-common"), ["_h", "_h2"])
        .filter(F.col("_d") != F.col("_last"))
        .groupBy("_d", "_v")
        .agg(F.sort_array(F.collect_set("_p")).alias("_cut"))
    )
    lines_of = F.split("_t", "\n", -1)
    joined = base.join(cut, ["_d", "_v"], "left").withColumn("_all", lines_of)
    # the cut positions as flags by position, so that the test of a line is one array access
    runs = F.transform(
        F.col("_cut"),
        lambda p, i: F.concat(
            F.repeat(F.lit("0"), p - F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("_cut"), i - 1) + 1)), F.lit("1")
        ),
    )
    flags = F.split(F.rpad(F.array_join(runs, ""), F.size("_all"), "0"), "")
    flagged = joined.withColumn("_f", F.when(F.col("_cut").isNotNull(), flags))
    kept = F.when(F.col("_f").isNull(), F.col("_t")).otherwise(
        F.array_join(F.filter("_all", lambda _, i: F.get(F.col("_f"), i) == "0"), "\n")
    )
    return flagged.select(
        id_or_null("_d").alias("doc_id"),
        F.size("_all").cast("long").alias("n_lines"),
        F.coalesce(F.size("_cut"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("text"),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
    )
