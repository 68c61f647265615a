"""Chat formatting: turn-aligned, budgeted windows with a kept system turn, repeated history and a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.common import id_or_lowest, id_or_null, written

#: Strings that steer chat models; inside texts and roles a backslash is put after their first character.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
END = "<|end|>\n"
#: What the estimate counts as tokens: runs of ASCII word characters, and every other character but blanks.
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t-\r]"
#: Estimated tokens of a turn's marks.
MARKS = 4
#: Rows of a few bytes that one task numbers and sums.
ROWS_A_RANGE = 500_000


def escaped(text: Column) -> Column:
    """Double backslashes, then break every control string; no control string is left, and unescaped() undoes it."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def estimated_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def running(turns: DataFrame) -> DataFrame:
    """Rows (_c, _turn, _role, _x, _i, _tok), a few bytes each: with _pos, the turn's number in its conversation, and _before, the tokens before it.

    Rows are dealt in the order of conversations and turns, numbered and summed within a range, and what a conversation has in earlier ranges is added. So one that
    holds any share of all rows takes as many tasks as its rows need."""
    parts = max(turns.count() // ROWS_A_RANGE + 1, turns.sparkSession.sparkContext.defaultParallelism)
    order = ["_turn", "_role", "_x", "_i"]
    held = written(turns.repartitionByRange(parts, "_c", *order).withColumn("_b", F.spark_partition_id()), "chat-ranges")
    sums = held.groupBy("_c", "_b").agg(F.count(F.lit(1)).alias("_n"), F.sum("_tok").alias("_s"))
    earlier = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(sums.select("_c", "_b", *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(x) for x in ("_n", "_s")]), "chat-sums")
    inside = Window.partitionBy("_c", "_b").orderBy(*order)
    sofar = F.coalesce(F.sum("_tok").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = held.select("*", F.row_number().over(inside).alias("_k"), sofar.alias("_l")).join(sums, ["_c", "_b"])
    return local.select("_c", "_i", "_role", "_tok", (F.col("_n") + F.col("_k")).alias("_pos"), (F.col("_s") + F.col("_l")).alias("_before"))


def format_conversations(turns: DataFrame, budget: int = 1024, history_turns: int = 2, history_tokens: int = 192, count_tokens: Callable[[Column], Column] = estimated_tokens) -> DataFrame:
    """Format each conversation as windows of whole turns of at most ``budget`` tokens.

    In: conv_id, turn, role, text (others are ignored), a row per turn; null text or role: empty. Out: a row per window
    with conv_id, window (ascending, with gaps), n_context (leading turns repeated from before), n_turns (new ones),
    text, and loss: the code-point spans [start, end) of text to learn from, which are the new assistant texts and
    nothing else. ``count_tokens`` gives a text's tokens, by default an estimate.

    A turn is ``<|role|>``, a newline, the escaped text and ``<|end|>``, a newline. With prefix sums of the turns' tokens, a window
    holds the turns whose sum before them lies in one multiple of the stride: half of the budget less the system turn and the history. A turn longer than
    the stride has a window of its own, so a window is over the budget only if one turn or the system turn alone exceeds it.
    A system turn at the start heads every window. Later windows then repeat up to
    ``history_turns`` turns of at most ``history_tokens`` together, and no repeated text is under the mask: each assistant
    text is learnt once.

    Order is by turn, then role and a hash of the text; equal rows are turns of their own. A null conv_id is a conversation. An empty
    table gives an empty table. Sums and windows are made of rows of a few bytes; texts meet them by the number of their row, one to a window.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # a role that would end its own marks, or be the end of a turn, is escaped at its start too
    guard = F.when(F.startswith(role, F.lit(">")) | (role == "end"), "\\").otherwise("")
    head = F.concat(F.lit("<|"), guard, escaped(role), F.lit("|>\n"))
    base = turns.select(id_or_lowest("conv_id").alias("_c"), F.col("turn").alias("_turn"), role.alias("_role"), text.alias("_raw"), head.alias("_head"), escaped(text).alias("_text"))
    base = base.select("*", F.xxhash64("_raw").alias("_x"), (count_tokens(F.col("_raw")) + MARKS).cast("long").alias("_tok"), F.monotonically_increasing_id().alias("_i"))
    base = written(base.drop("_raw"), "chat-turns")
    placed = written(running(base.select("_c", "_turn", "_role", "_x", "_i", "_tok")), "chat-placed")
    system = written(placed.filter("_pos = 1 and _role = 'system'").select("_c", F.col("_i").alias("_sys"), F.col("_tok").alias("_sys_tok")), "chat-system")
    stride = F.greatest(F.lit(1), F.floor((budget - F.coalesce("_sys_tok", F.lit(0)) - history_tokens) / 2))
    placed = placed.join(system, "_c", "left").withColumn("_window", 2 * F.floor(F.col("_before") / stride) + (F.col("_tok") > stride).cast("int"))
    placed = written(placed.select("_c", "_i", "_pos", "_before", "_sys", "_window"), "chat-windows")
    starts = placed.groupBy("_c", "_window").agg(F.min(F.struct("_pos", "_before", "_sys")).alias("_f")).select("_c", "_window", "_f.*")
    heads = starts.filter("_pos > 1 and _sys is not null").select("_c", "_window", F.lit(0).cast("long").alias("_pos"), F.col("_sys").alias("_i"))
    back = starts.select("_c", "_window", F.col("_before").alias("_at"), F.explode(F.sequence(F.greatest(F.col("_pos") - history_turns, F.lit(0)), F.col("_pos") - 1)).alias("_pos"))
    past = back.join(placed.select("_c", "_pos", "_i", "_before", "_sys"), ["_c", "_pos"]).filter((F.col("_at") - F.col("_before") <= history_tokens) & ((F.col("_pos") > 1) | F.col("_sys").isNull()))
    fresh = F.lit(True).alias("_new")
    rows = placed.select("_c", "_window", "_pos", "_i", fresh).unionByName(heads.unionByName(past.select("_c", "_window", "_pos", "_i")).withColumn("_new", F.lit(False)))
    said = rows.join(base.select("_i", "_role", "_head", "_text"), "_i")
    size = lambda x: F.char_length(x).cast("long")
    inside = Window.partitionBy("_c", "_window").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size("_head") + size("_text") + len(END)).over(inside), F.lit(0)) + size("_head")
    said = said.withColumn("_at", start.cast("int"))
    target = F.when(F.col("_new") & (F.col("_role") == "assistant"), F.struct(F.col("_at").alias("start"), (F.col("_at") + F.char_length("_text")).cast("int").alias("end")))
    windows = said.groupBy("_c", "_window").agg(
        F.sort_array(F.collect_list(F.struct("_pos", F.concat("_head", "_text", F.lit(END)).alias("_body")))).alias("_bodies"),
        F.sort_array(F.collect_list(target)).alias("loss"),
        F.sum((~F.col("_new")).cast("int")).cast("int").alias("n_context"),
        F.sum(F.col("_new").cast("int")).cast("int").alias("n_turns"),
    )
    formatted = F.array_join(F.transform("_bodies", lambda x: x["_body"]), "")
    return windows.select(id_or_null("_c").alias("conv_id"), F.col("_window").alias("window"), "n_context", "n_turns", formatted.alias("text"), "loss")


def read_back(windows: DataFrame) -> DataFrame:
    """What formatted windows say: per conversation n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns are parsed from the windows' texts, without the repeated ones, and unescaped; the masked text is taken by the
    loss spans. A conversation's windows are hashed as they stream by, so it is never held whole.
    """

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, count, chars, learnt, turns, loss = None, 0, 0, 0, None, None
        done: list[tuple] = []

        def close() -> None:
            if turns is not None:
                done.append((now, count, turns.hexdigest(), learnt, loss.hexdigest(), chars))

        for frame in frames:
            for key, n_context, text, spans in zip(frame["_c"], frame["n_context"], frame["text"], frame["loss"], strict=True):
                if turns is None or key != now:
                    close()
                    now, count, chars, learnt, turns, loss = key, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for part in text.split(END)[n_context:-1]:
                    role, _, said = part.partition("|>\n")
                    turns.update(f"{unescaped(role[2:])}\n{unescaped(said)}\n".encode())
                    count += 1
                for span in spans:
                    said = unescaped(text[span["start"] : span["end"]])
                    loss.update(said.encode())
                    learnt += len(said)
                chars += len(text)
            if done:
                yield pd.DataFrame(done, columns=names)
                done.clear()
        close()
        yield pd.DataFrame(done, columns=names)

    names = ["_c", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    dealt = windows.select(id_or_lowest("conv_id").alias("_c"), "window", "n_context", "text", "loss").repartition("_c").sortWithinPartitions("_c", "window")
    out = dealt.mapInPandas(digest, "_c long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.select(id_or_null("_c").alias("conv_id"), *names[1:])
