"""Quality rules: text statistics and robust multivariate outliers by language and source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.common import BLANKS, broadcast_if_small, id_or_lowest, id_or_null, written

DIMENSIONS = ("x0", "x1", "x2", "x3", "x4")
#: Quantiles (50, 97.5 and 99.99 %) of the chi-squared distribution with as many degrees of freedom as there are transformed statistics.
CHI2_MEDIAN, CHI2_INNER, CHI2_CUTOFF = 4.3515, 12.8325, 25.7448
#: Stands for a null, and for every language or source in the fits of more than one.
NULL, EVERY = "\0", "\0\0"
#: Groups whose fits are broadcast, at about 250 bytes each; more are joined by shuffle.
MOST_GROUPS = 20_000
#: Bins into which values are counted, and rows of a bin that is not counted in finer ones; both change no result.
BINS, BIN_ROWS = 4_096, 200_000


def text_statistics(docs: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text, with DataFrame functions only.

    In: text and any others; those named like a result are left out. Out: the input's columns and these five (long). Null text has no words and no lines.
    Repeated three-word windows are found by sorting the windows' hashes, each with its position in the low bits, so that
    equal windows are neighbours; a text of n words takes n log n steps, however long it is.
    """
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_w", "_h", "_t", "_m", "_s")
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    with_words = docs.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    simple = with_words.select(
        *docs.columns,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.when(F.instr(text, "\n") == 0, F.lit(0)).otherwise(F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    windows = F.transform("_h", lambda h, i: F.xxhash64(h, F.get("_h", i + 1), F.get("_h", i + 2)))
    windows = simple.withColumn("_t", F.slice(windows, F.lit(1), F.greatest(F.size("_h") - 2, F.lit(0))))
    # positions fit under a power of two over the number of windows
    width = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("_t") + 2.0))).cast("long")
    packed = windows.withColumn("_m", width).withColumn(
        "_s", F.when(F.size(F.array_distinct("_t")) < F.size("_t"), F.sort_array(F.transform("_t", lambda t, i: t - F.pmod(t, F.col("_m")) + i)))
    )
    at = lambda v: F.get("_t", F.pmod(v, F.col("_m")).cast("int"))  # noqa: E731  the whole hash of a sorted entry
    again = F.filter("_s", lambda v, i: F.coalesce(at(v) == at(F.get("_s", i - 1)), F.lit(False)) | F.coalesce(at(v) == at(F.get("_s", i + 1)), F.lit(False)))
    covered = F.flatten(F.transform(again, lambda v: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.pmod(v, F.col("_m")) + k)))
    repeated = F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long")
    return packed.withColumn("n_repeat_words", F.when(F.col("_s").isNull(), F.lit(0)).otherwise(repeated).cast("long")).drop("_h", "_t", "_m", "_s")


def transformed() -> dict[str, Column]:
    """The statistics on scales where they are nearly normal."""
    n = F.col("n_words")
    return {
        "x0": F.log1p(n),
        "x1": F.log((F.col("word_chars") + 1) / (n + 1)),
        "x2": F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 1)),
        "x3": F.sqrt(F.col("n_repeat_words") / (n + 1)),
        "x4": F.sqrt(F.col("n_dup_lines") / (n + 1)),
    }


def least_deviations(words: float, chars: float) -> list[float]:
    """The least standard deviation of each dimension: half of what one event of its statistic changes in a text of so many words and characters in words.

    The events are a word, a symbol, a three-word window said twice (six words) and a line said twice; a mean word length has the error of a mean of words
    whose lengths deviate by half. Symbols, repeats and repeated lines are
    none in most texts, so that the spread of the innermost rows is nought and any text with a single one would be far out.
    """
    return [0.5 / (words + 1), 0.5 / (words + 1) ** 0.5, 0.5 / (chars + 1) ** 0.5, 0.5 * (6 / (words + 1)) ** 0.5, 0.5 / (words + 1) ** 0.5]


def covariances() -> list[str]:
    return [f"c{i}{j}" for i in range(len(DIMENSIONS)) for j in range(i + 1)]


def cholesky(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Each group's centre, the Cholesky factor of its covariance (l00 ..) and log_det."""
    p = len(DIMENSIONS)
    fits = fits.select(*keys, *[f"m{i}" for i in range(p)], *covariances())
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            fits = fits.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    det = F.lit(0.0)
    for i in range(p):
        det = det + 2 * F.log(F.col(f"l{i}{i}"))
    return fits.withColumn("log_det", det).drop(*covariances())


def with_distance(rows: DataFrame, fits: DataFrame, keys: list[str], how: str = "inner", few: bool | None = None) -> DataFrame:
    """Join each group's centre and covariance and add d2, the squared Mahalanobis distance, and log_det, by a Cholesky factor in columns. ``few`` as in order_statistics(); None: the groups are counted."""
    p = len(DIMENSIONS)
    factors = cholesky(fits, keys)
    if few is None:
        factors = broadcast_if_small(written(factors, "mcd-factors"), MOST_GROUPS)
    out = rows.join(F.broadcast(factors) if few else factors, keys, how)
    total = F.lit(0.0)
    for i in range(p):
        step = F.col(DIMENSIONS[i]) - F.col(f"m{i}")
        for j in range(i):
            step = step - F.col(f"l{i}{j}") * F.col(f"z{j}")
        out = out.withColumn(f"z{i}", step / F.col(f"l{i}{i}"))
        total = total + F.col(f"z{i}") * F.col(f"z{i}")
    return out.withColumn("d2", total).select(*rows.columns, "log_det", "d2")


def moments(rows: DataFrame, keys: list[str], inside: Column, least: list[float]) -> DataFrame:
    """Centre and covariance of each group's rows that are inside, with the squares of ``least`` added to the variances; n is the number of all its rows."""
    p = len(DIMENSIONS)
    x = [F.when(inside, F.col(d)) for d in DIMENSIONS]
    means = [F.avg(x[i]).alias(f"m{i}") for i in range(p)]
    ridge = lambda i, j: F.lit(least[i] ** 2 if i == j else 0.0)
    sums = [(F.covar_pop(x[i], x[j]) + ridge(i, j)).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(*means, *sums, F.count(F.lit(1)).alias("n"))


def group_sizes(rows: DataFrame, keys: list[str]) -> tuple[bool, int]:
    """Whether tables of a row per group are small enough to be broadcast, and the rows of the largest group."""
    groups, most = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.max("n")).first()
    return groups <= MOST_GROUPS, most or 0


def order_statistics(rows: DataFrame, keys: list[str], values: dict[str, Column], share: float, name: str, few: bool, bin_rows: int = BIN_ROWS, most: int | None = None) -> DataFrame:
    """Of each group and named value the least one that ``share`` of its rows do not exceed, exactly: a row per group (written), however the rows are dealt.

    In: rows with keys (none: one group) and values that are not null; ``few``: that the groups may be broadcast; ``most``: rows of the largest group, if known. Values are counted in bins of fixed bounds, a hundredth wide; the counts, which are sums, tell the bin that has the statistic and its rank
    there. While that bin has over ``bin_rows`` rows of several values it is counted in ``BINS`` finer ones. Its values are then counted singly. So a task gets a few thousand rows, or ``bin_rows`` values, of a group of any size.
    Where no group has over ``bin_rows`` rows no bin has, and all is one query of Spark's.
    """
    within = most is not None and most <= bin_rows
    given = lambda table: F.broadcast(table) if few else table
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.cast("double").alias("v")) for i, c in enumerate(values.values())])).alias("_e")
    placed = rows.select(*keys, each).select(*keys, "_e.*")
    by = [*keys, "i"]

    def chosen(binned: DataFrame, rank: Column) -> DataFrame:
        counted = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("rank").alias("rank"))
        order = Window.partitionBy(*by)
        told = counted.withColumns({"_sum": F.sum("n").over(order.orderBy("bin")), "_all": F.sum("n").over(order)}).withColumn("rank", rank)
        found = told.filter((F.col("_sum") >= F.col("rank")) & (F.col("_sum") - F.col("n") < F.col("rank")))
        found = found.select(*by, "lo", "hi", "n", (F.col("rank") - F.col("_sum") + F.col("n")).alias("rank"))
        return found if within else written(found, f"{name}-bins")

    v = F.col("v")
    fixed = F.floor(F.signum(v) * F.log1p(F.abs(v) * 1e6) * 100)
    target = chosen(placed.withColumns({"bin": fixed, "rank": F.lit(0).cast("long")}), F.greatest(F.ceil(F.col("_all") * share), F.lit(1)))
    inside = lambda: placed.join(given(target), by).filter((v >= F.col("lo")) & (v <= F.col("hi")))
    while not within and (target.filter("lo < hi").agg(F.max("n")).first()[0] or 0) > bin_rows:
        finer = F.least(F.floor((v - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * BINS), F.lit(BINS))
        target = chosen(inside().withColumn("bin", F.coalesce(finer, F.lit(0))).select(*by, "v", "bin", "rank"), F.col("rank"))
    singly = inside().groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"), F.first("rank").alias("rank"))
    found = singly.withColumn("_sum", F.sum("n").over(Window.partitionBy(*by).orderBy("v"))).filter(F.col("_sum") >= F.col("rank"))
    return written(found.groupBy(*keys).agg(*[F.min(F.when(F.col("i") == i, v)).alias(n) for i, n in enumerate(values)]), name)


def medians(rows: DataFrame, keys: list[str], few: bool, most: int) -> DataFrame:
    """Of each group the median of each dimension, q0 .. (written)."""
    return order_statistics(rows, keys, {f"q{i}": F.col(d) for i, d in enumerate(DIMENSIONS)}, 0.5, "mcd-median", few, most=most)


def fit_mcd(rows: DataFrame, keys: list[str], least: list[float], share: float = 0.75, steps: int = 3, sizes: tuple[bool, int] | None = None, middle: DataFrame | None = None) -> DataFrame:
    """Minimum-covariance-determinant centre and covariance of each group, by concentration steps from two starts.

    In: rows with keys and x0 .. x4, to be read many times (written); ``sizes`` and ``middle``: their group_sizes() and medians(), if known. Out: a row per group with n, m0.. and c00..,
    scaled so that the median squared distance is that of a chi-squared variable, if that is more. The starts are the rows nearest to the
    median by MAD-scaled distance, summed or at its largest; each step refits on the ``share`` of rows of least distance;
    the start whose last covariance has the smaller determinant stays, and is fitted once more on all rows within the 97.5 %
    quantile of its scaled distances, since the share alone takes the spread of rare statistics for nought.

    A group may hold any share of all rows: its aggregates are sums and counts, combined before the shuffle, and order statistics are exact, so that no fit depends on how rows are dealt; what
    comes back to the rows is a written table of a row per group, broadcast, or joined by a shuffle that Spark can split.
    """
    scale = F.greatest(F.col("d2") / CHI2_MEDIAN, F.lit(1.0)).alias("scale")
    few, most = sizes or group_sizes(rows, keys)
    median = lambda table, by, name: order_statistics(table, by, {"d2": F.col("d2")}, 0.5, f"mcd-{name}", few, most=most)
    given = lambda table: F.broadcast(table) if few else table
    middle = medians(rows, keys, few, most) if middle is None else middle
    away = rows.join(given(middle), keys).withColumns({f"y{i}": F.abs(F.col(d) - F.col(f"q{i}")) for i, d in enumerate(DIMENSIONS)})
    mads = order_statistics(away, keys, {f"a{i}": F.col(f"y{i}") for i in range(len(DIMENSIONS))}, 0.5, "mcd-mad", few, most=most)
    scaled = [F.pow(F.col(f"y{i}") / (1.4826 * F.col(f"a{i}") + least[i]), 2.0) for i in range(len(DIMENSIONS))]
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("start"), d.alias("d2")) for k, d in enumerate((sum(scaled[1:], scaled[0]), F.greatest(*scaled)))]))
    at = away.join(given(mads), keys).select(*rows.columns, both.alias("_s")).select(*rows.columns, "_s.start", "_s.d2")
    group = [*keys, "start"]
    twice = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    for step in range(steps):
        limit = order_statistics(at, group, {"_limit": F.col("d2")}, share, f"mcd-limit-{step}", few, most=most)
        fits = written(moments(at.join(given(limit), group), group, F.col("d2") <= F.col("_limit"), least), f"mcd-{step}")
        at = with_distance(twice, fits, group, few=few)
    held = ["n", *[f"m{i}" for i in range(len(DIMENSIONS))], *covariances()]
    placed = cholesky(fits, group).select(*group, "log_det").join(fits, group)
    best = placed.groupBy(*keys).agg(F.min_by(F.struct(*held), F.struct("log_det", "start")).alias("_b"))
    best = written(best.select(*keys, "_b.*"), "mcd-best")
    halves = median(with_distance(rows, best, keys, few=few), keys, "halves").select(*keys, scale)
    inner = with_distance(rows, best, keys, few=few).join(given(halves), keys)
    fits = written(moments(inner, keys, F.col("d2") <= CHI2_INNER * F.col("scale"), least), "mcd-inner")
    scales = median(with_distance(rows, fits, keys, few=few), keys, "scales").select(*keys, scale)
    return written(fits.join(scales, keys).withColumns({c: F.col(c) * F.col("scale") for c in covariances()}).drop("scale"), "mcd")


def shrunk(own: DataFrame, parent: dict[str, Column], prior_rows: float, apart: bool) -> DataFrame:
    """Groups' centres and covariances as mixtures with a parent's, which weighs as much as ``prior_rows`` rows; no group is too small for one.

    With ``apart`` the groups are taken to differ as such, and the mixture's covariance has the distance of the two centres in it."""
    w = F.col("n") / (F.col("n") + F.lit(float(prior_rows)))
    away = [F.col(f"m{i}") - parent[f"m{i}"] for i in range(len(DIMENSIONS))]
    mixed = {f"m{i}": w * F.col(f"m{i}") + (1 - w) * parent[f"m{i}"] for i in range(len(DIMENSIONS))}
    for i in range(len(DIMENSIONS)):
        for j in range(i + 1):
            mixed[f"c{i}{j}"] = w * F.col(f"c{i}{j}") + (1 - w) * parent[f"c{i}{j}"] + (w * (1 - w) * away[i] * away[j] if apart else F.lit(0.0))
    return own.withColumns(mixed)


def quality_fits(good: DataFrame, prior_rows: float) -> DataFrame:
    """A row per language and source (_l, _s0) with the centre and covariance to judge its rows by: its own, shrunk to its language's, which is
    shrunk to that of all rows, which is shrunk to the plain moments of all rows.

    In: rows with _l, _s0, x0 .. x4 (written). Languages are taken to differ as such, sources of a language are not. In a table of few rows, whose plain spread holds its outliers too, none is far out."""
    keys = ["_l", "_s0"]
    names = [*[f"m{i}" for i in range(len(DIMENSIONS))], *covariances()]
    levels = F.explode(F.array(*[F.struct(a.alias("_l"), b.alias("_s0")) for a, b in ((F.lit(EVERY), F.lit(EVERY)), (F.col("_l"), F.lit(EVERY)), (F.col("_l"), F.col("_s0")))]))
    rows = good.select(levels.alias("_k"), *DIMENSIONS).select("_k.*", *DIMENSIONS)
    sizes = group_sizes(rows, keys)
    middle = medians(rows, keys, *sizes)
    of_every = middle.filter(F.col("_l") == EVERY).first()
    x0, x1 = (of_every.q0 or 0.0, of_every.q1 or 0.0) if of_every else (0.0, 0.0)
    words = math.expm1(x0)
    least = least_deviations(words, math.exp(x1) * (words + 1) - 1)
    plain = moments(good.select(*DIMENSIONS), [], F.lit(True), least).first()
    of_all = {x: F.lit(plain[x] or 0.0) for x in names}
    fits = fit_mcd(rows, keys, least, sizes=sizes, middle=middle)
    everything = shrunk(fits.filter(F.col("_l") == EVERY), of_all, prior_rows, True).first()
    if everything is None:
        return fits
    languages = shrunk(fits.filter((F.col("_l") != EVERY) & (F.col("_s0") == EVERY)), {x: F.lit(everything[x]) for x in names}, prior_rows, True)
    parents = written(languages.select("_l", *[F.col(x).alias(f"p_{x}") for x in names]), "mcd-languages")
    sources = fits.filter(F.col("_s0") != EVERY).join(parents, "_l")
    return written(shrunk(sources, {x: F.col(f"p_{x}") for x in names}, prior_rows, False).select(*keys, "n", *names), "mcd-fits")


def judge_quality(docs: DataFrame, cutoff: float = CHI2_CUTOFF, prior_rows: float = 40, min_words: int = 50, most_repeated: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """Reject short or repetitive texts, and outliers of their language and source.

    In: doc_id, text, lang, source (others are ignored). Out: a row per input row with doc_id, the five statistics,
    base_failed, d2 (squared robust distance; null if not judged), kept, and the input columns named
    in ``keep``, which are written with the statistics, so that no join has to bring them back.

    A text of under ``min_words`` words or with over ``most_repeated`` percent of its words in repeated three-word windows
    fails the base rules. The others of each (lang, source), nulls being a value of their own, are held against a minimum-covariance-
    determinant fit of their group, and those over ``cutoff`` are rejected. A fit is shrunk to that of the language and of all rows, which weigh as
    much as ``prior_rows`` rows, so a group of any size is judged. Repeated rows each count and each get a row; an empty table gives an
    empty table; a very long text is one row of array functions. Only DataFrame functions are used.
    """
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULL))
    base = text_statistics(docs.select(id_or_lowest("doc_id").alias("_d"), key("lang").alias("_l"), key("source").alias("_s0"), F.col("text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])).drop("text")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    stats = written(base.withColumn("base_failed", failed).withColumns(transformed()), "quality")
    fits = quality_fits(stats.filter(~F.col("base_failed")).select("_l", "_s0", *DIMENSIONS), prior_rows)
    judged = with_distance(stats, fits, ["_l", "_s0"], "left").withColumn("d2", F.when(~F.col("base_failed"), F.col("d2")))
    verdict = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff)
    return judged.select(id_or_null("_d").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", verdict.alias("kept"), *[F.col(f"_keep_{c}").alias(c) for c in keep])
