"""Structured search: configuration symbols scored for the concepts of questions, one seed a record, and the code that their relations lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.functions import text as T
from tracewell.operators.retrieval import structured_score

#: What a concept found in a field counts.
PRECISION = {"names": 1.0, "declared_values": 0.9, "descriptive": 0.7, "structural": 0.5}
#: What a relation leaves of a seed's score, and its least score.
DECAY, LEAST = 0.95, 0.01


def _singular(token: Column) -> Column:
    """A plural of five letters or more by its ending, as its singular; else the token."""
    n = F.char_length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    return (
        F.when(token.endswith("iones") & (n > 6), cut(2))
        .when(token.endswith("ces") & (n > 5), F.concat(cut(3), F.lit("z")))
        .when(token.endswith("s") & ~token.endswith("sis") & (n >= 5), cut(1))
        .otherwise(token)
    )


def concept_variants(token: Column) -> Column:
    """A folded token with what else it may be written as: its singular, or the parts of four letters or more between its underscores with theirs."""
    parts = F.filter(F.split(token, "_"), lambda p: F.char_length(p) >= 4)
    of_parts = F.flatten(F.transform(parts, lambda p: F.array(p, _singular(p))))
    return F.array_sort(F.array_distinct(F.when(F.contains(token, F.lit("_")), F.concat(F.array(token), of_parts)).otherwise(F.array(token, _singular(token)))))


def concept_groups(text: Column, stopwords: list[str]) -> Column:
    """The different concepts of a question, each an array of variants: tokens of four characters or with an underscore, but for citation marks and those that a stopword is a variant of."""
    tokens = F.filter(T.folded_words(text), lambda t: ((F.char_length(t) >= 4) | F.contains(t, F.lit("_"))) & ~t.rlike(r"^f\d+$"))
    stop = F.array(*map(F.lit, stopwords)) if stopwords else F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.transform(tokens, concept_variants), lambda g: ~F.arrays_overlap(g, stop)))


def query_identifiers(text: Column) -> Column:
    """Tokens of a question that name something: with an underscore and a letter. A question that is one qualified name has none; it is held against whole names."""
    qualified = F.contains(text, F.lit(".")) & ~F.btrim(text).rlike(r"\s")
    return F.when(qualified, F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(T.folded_words(text), lambda t: F.contains(t, F.lit("_")) & t.rlike("[a-z]"))))


def structured_scores(questions: DataFrame, symbols: DataFrame, stopwords: list[str]) -> DataFrame:
    """(query_id, symbol_id, record_id, matched, score) of every symbol with a concept of a question.

    questions: query_id, text. symbols: symbol_id, record_id (the record that it is part of, or itself), original_name, normalized_name, and four arrays of tokens: names, declared_values, descriptive, structural. The score weighs how many of the concepts are met, how rare they are
    among records (a record has the concepts of all its symbols), in which fields, and whether the question names the symbol. Concepts meet tokens by an equi-join, all questions at once; frequencies are counted from what met.
    """
    asked = questions.select("query_id", "text", F.posexplode(concept_groups(F.col("text"), stopwords)).alias("g", "_v"))
    asked = asked.withColumn("_total", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    wanted = asked.select("query_id", "g", "_total", F.explode("_v").alias("token"))
    weighed = lambda weight: lambda t: F.struct(t.alias("token"), F.lit(weight).alias("precision"))
    fields = F.flatten(F.array(*[F.transform(F.col(f), weighed(weight)) for f, weight in PRECISION.items()]))
    held = symbols.select("symbol_id", "record_id", F.explode(fields).alias("_f")).select("symbol_id", "record_id", "_f.*")
    # a batch of questions is small, symbols and their names are not: only the former goes to every executor
    met = held.join(F.broadcast(wanted), "token").groupBy("query_id", "symbol_id", "record_id", "g").agg(F.max("precision").alias("precision"), F.first("_total").alias("_total"))
    frequency = met.select("query_id", "g", "record_id").distinct().groupBy("query_id", "g").agg(F.count(F.lit(1)).alias("frequency"))
    records = symbols.agg(F.count_distinct("record_id").alias("records"))
    rarity = T.smoothed_idf(F.col("records"), F.col("frequency"))
    scored = met.join(frequency, ["query_id", "g"]).join(F.broadcast(records))  # one row
    each = scored.groupBy("query_id", "symbol_id", "record_id").agg(F.count(F.lit(1)).alias("matched"), F.first("_total").alias("_total"), F.avg(rarity).alias("_rarity"), F.avg("precision").alias("_precision"))
    said = questions.select("query_id", F.btrim(T.fold_accents(F.col("text"))).alias("_text"), query_identifiers(F.col("text")).alias("_ids"))
    names = symbols.select("symbol_id", T.fold_accents(F.col("original_name")).alias("_a"), T.fold_accents(F.col("normalized_name")).alias("_b"))
    each = each.join(F.broadcast(said), "query_id").join(names.hint("merge"), "symbol_id")
    exact = (F.col("_text") == F.col("_a")) | (F.col("_text") == F.col("_b")) | F.arrays_overlap("_ids", T.folded_words(F.concat_ws(" ", "_a", "_b")))
    several = F.least(F.lit(1.0), (F.col("matched") - 1) / 2.0)
    # the weight of several concepts grows up to three of them
    score = structured_score(F.col("matched") / F.col("_total"), F.least(F.lit(1.0), F.col("matched") / 3.0), F.col("_rarity"), F.col("_precision"), F.lit(False), F.lit(False)) + 0.10 * several + F.when(exact, 0.1).otherwise(0.0)
    return each.select("query_id", "symbol_id", "record_id", "matched", F.least(F.lit(1.0), score).alias("score"))


def structured_candidates(scores: DataFrame, roots: DataFrame, relations: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` candidates of each question: (query_id, rank, kind, symbol_id, chunk_id, score), rank from 0.

    scores: the rows of structured_scores(). A record's best symbol, by score and id, is its seed. Seeds come in that order, each followed by the code that relations of its roots lead to, by relation, at DECAY of its score; a chunk that came before
    is left out. roots: symbol_id, root_id (a symbol's own id and its ancestors'). relations: root_id, relation_id, chunk_id (of an active symbol outside of configurations).
    """
    best = scores.groupBy("query_id", "record_id").agg(F.min_by(F.struct("symbol_id", "score"), F.struct((-F.col("score")).alias("s"), "symbol_id")).alias("_b")).select("query_id", "_b.*")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "symbol_id")
    # a seed brings at least itself, so no more than ``limit`` seeds are needed
    seeds = best.withColumn("_seed", F.row_number().over(order)).filter(F.col("_seed") <= limit)
    none = F.lit(None)
    chunk = dict(relations.dtypes)["chunk_id"]
    own = seeds.select("query_id", "_seed", none.cast(dict(relations.dtypes)["relation_id"]).alias("relation_id"), F.lit("structured").alias("kind"), "symbol_id", none.cast(chunk).alias("chunk_id"), "score")
    related = roots.join(F.broadcast(seeds), "symbol_id").join(relations, "root_id").groupBy("query_id", "chunk_id").agg(F.min(F.struct("_seed", "relation_id", "symbol_id", "score")).alias("_f")).select("query_id", "chunk_id", "_f.*")
    related = related.select("query_id", "_seed", "relation_id", F.lit("related").alias("kind"), "symbol_id", "chunk_id", F.greatest(F.lit(LEAST), DECAY * F.col("score")).alias("score"))
    place = Window.partitionBy("query_id").orderBy("_seed", F.col("kind") == "related", "relation_id", "chunk_id")
    return own.unionByName(related).withColumn("rank", F.row_number().over(place) - 1).filter(F.col("rank") < limit).select("query_id", "rank", "kind", "symbol_id", "chunk_id", "score")
