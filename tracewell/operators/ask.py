"""From questions and their candidates to prompts, and from answers to verdicts, for all questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators.context import citation_report
from tracewell.operators.overlap import trim_overlaps
from tracewell.operators.prompts import fit_prompts

#: What a prompt says besides its question and sources.
INSTRUCTIONS = "Answer from the sources alone and cite each statement's source, as in [F1]. If they do not answer the question, say so.\n\n"
QUESTION, SOURCES, FORMAT = "Question:\n", "\n\nSources:\n", "\nAnswer:\n"


def _heading(source_id: Column, label: Column) -> Column:
    return F.concat(F.lit("["), source_id, F.lit("] "), F.coalesce(label, F.lit("")), F.lit("\n"))


def compose(questions: DataFrame, candidates: DataFrame, budget: int, least_tokens: int = 8) -> tuple[DataFrame, DataFrame]:
    """Prompts of at most ``budget`` estimated tokens: (query_id, n_sources, prompt_tokens, result, prompt), and the sources that they send: (query_id, source_id, chunk_id, content, decision).

    questions: query_id, text. candidates: query_id, rank (their order), chunk_id, label, document_id, ordinal, start_line, end_line, content: a search's top rows. A source that continues another of its document loses what both hold. Sources are then numbered F1, F2 ... by rank and sent as
    far as the prompt's estimate allows, the last one cut. Questions without a source that fits get a prompt without sources; null texts are empty.

    Sizes alone decide what fits; the contents that are sent, at most four times ``budget`` characters a question, are put together once.
    """
    rows = candidates.select(F.col("query_id").alias("context_id"), "document_id", F.col("rank").cast("long").alias("source_id"), "ordinal", "start_line", "end_line", "content")
    cut = trim_overlaps(rows).select(F.col("context_id").alias("query_id"), F.col("source_id").alias("rank"), "content", "trimmed_chars")
    named = candidates.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "label").join(cut, ["query_id", "rank"])
    # numbers follow the ranks, which may have gaps
    order = F.array_sort(F.collect_list("rank"))
    places = named.groupBy("query_id").agg(order.alias("_ranks"))
    named = named.join(places, "query_id").withColumn("source_id", F.concat(F.lit("F"), F.array_position("_ranks", F.col("rank")).cast("string"))).drop("_ranks")
    sized = named.select("query_id", "rank", F.char_length(_heading(F.col("source_id"), F.col("label"))).cast("long").alias("head_chars"), (F.char_length("content") + 1).cast("long").alias("content_chars"))
    asked = questions.select("query_id", F.coalesce("text", F.lit("")).alias("_q"))
    overheads = asked.select("query_id", (F.char_length("_q") + len(INSTRUCTIONS + QUESTION + SOURCES + FORMAT)).cast("long").alias("overhead_chars"))
    fitted, told = fit_prompts(sized, overheads, budget, least_tokens)
    sent = fitted.filter("decision != 'budget'").select("query_id", "rank", "decision", "chars_sent").join(named, ["query_id", "rank"])
    # the newline after a content is one of its characters
    sent = sent.withColumn("content", F.substring("content", F.lit(1), F.greatest(F.col("chars_sent") - 1, F.lit(0)).cast("int")))
    blocks = sent.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(_heading(F.col("source_id"), F.col("label")), "content", F.lit("\n")).alias("b")))).alias("_b"))
    joined = F.coalesce(F.array_join(F.transform("_b", lambda x: x["b"]), ""), F.lit(""))
    prompt = F.concat(F.lit(INSTRUCTIONS + QUESTION), "_q", F.lit(SOURCES), joined, F.lit(FORMAT))
    prompts = told.join(asked, "query_id").join(blocks, "query_id", "left").select("query_id", "n_sources", "prompt_tokens", "result", prompt.alias("prompt"))
    return prompts, sent.select("query_id", "source_id", "chunk_id", "content", "decision")


def verify(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """A verdict on each answer by the sources that its prompt sent: the columns of citation_report(), query_id first. answers: query_id, text. An answer whose prompt sent nothing can cite nothing."""
    found = citation_report(answers.withColumnRenamed("query_id", "answer_id"), sources.select(F.col("query_id").alias("answer_id"), "source_id"))
    return found.withColumnRenamed("answer_id", "query_id")


def first_lines(sources: DataFrame) -> DataFrame:
    """The answer of an extractive model: of each question the first line of its first two sources, each with its citation: (query_id, text)."""
    line = F.concat(T.strip(F.substring_index("content", "\n", 1)), F.lit(" ["), "source_id", F.lit("]"))
    kept = sources.filter(F.col("source_id").isin("F1", "F2")).select("query_id", F.struct("source_id", line.alias("l")).alias("s"))
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["l"]), "\n").alias("text"))
