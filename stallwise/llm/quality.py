"""Quality rules: counts per text, then robust multivariate outliers per language and source.

The counts are native array expressions within one row; nothing is exploded or shuffled for them. The
outlier test works on a narrow written table of transformed shares. Location and scatter of each
(language, source) group are minimum-covariance-determinant estimates: from two starts (medians with
spreads, and the plain moments) repeated concentration steps refit on the share ``core`` of rows nearest to
the estimate, and the start with the smaller determinant wins. The scatter of the nearest rows is scaled to
that of all rows of a normal distribution. A text is rejected when its squared Mahalanobis distance exceeds
``cutoff``.

Every step is an aggregate with map-side combination per group, so a hot source costs one partial row per
task; the estimates have one row per group; up to ``BROADCAST_GROUPS`` of them are broadcast. Each share has a tolerance that is
added to the scatter, so a group in which a share is constant does not reject every small deviation.
A group's estimate is that of its texts together with ``prior`` texts that are as all texts are: the location
and scatter of this mixture, with weight n / (n + prior) on the group's own estimate. So the verdict changes
little from one size to the next; few texts are judged as all are, and many as their own group.

Edge cases: a null text has no words; null language or source are groups of their own; texts without a word
or under the base rules are rejected by those and take no part in the estimates (where no text of a group passes
them, ``distance`` is null); repeated rows get equal verdicts; an empty table gives an empty result; other columns are ignored (``keep_good`` passes them through).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import materialise
from .base import SPACES, text_of, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = r"[^#*$%&|<>]+"
CORE = 0.75
STEPS = 3
# a group of fewer texts than this is judged more by all texts than by its own
PRIOR = 100
# estimates of up to so many groups (600 bytes each, two starts) are broadcast, more are joined by a shuffle
BROADCAST_GROUPS = 10_000
# key of the estimate over all texts
EVERY = "\0all"
# chi-squared with six degrees of freedom: one in a thousand of normally scattered texts lies beyond
CUTOFF = 22.46
# (statistic, tolerance): a standard deviation of this size is added to the scatter
STATISTICS = (
    ("symbol_share", 0.15),
    ("upper_share", 0.06),
    ("punct_share", 0.06),
    ("repeat_share", 0.15),
    ("dup_line_share", 0.15),
    ("word_length", 0.10),
)
D = len(STATISTICS)
X = [name for name, _ in STATISTICS]
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def _same_window(a: str, b: str) -> str:
    """SQL: the windows at the sorted places ``a`` and ``b`` have the same three words."""
    return " and ".join(
        f"_w[cast(_s[{a}] & _mask as int) + {k}] = _w[cast(_s[{b}] & _mask as int) + {k}]" for k in range(3)
    )


def with_counts(docs: DataFrame, text: str, *others: Column) -> DataFrame:
    """``others`` and per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_lines, n_upper, n_punct."""
    df = docs.select(*others, text_of(text).alias("_text"))
    df = df.select("*", words_of(F.col("_text")).alias("_w"))
    df = df.select("*", F.size("_w").alias("_n"))
    df = df.select("*", F.expr("length(bin(_n))").alias("_b"))
    df = df.select("*", F.expr("shiftleft(1L, _b) - 1L").alias("_mask"))
    # each window is one long, hash in the high bits and position in the low ones: sorting brings equal ones together
    packed = F.expr(
        """case when _n >= 4 then sort_array(transform(sequence(0, _n - 3),
             i -> shiftleft(xxhash64(_w[i], _w[i + 1], _w[i + 2]), _b) | cast(i as bigint))) end"""
    )
    df = df.select("*", packed.alias("_s"))
    # _near[k]: the sorted windows k and k + 1 have equal hash bits; the words confirm it
    near = F.expr("zip_with(slice(_s, 1, size(_s) - 1), slice(_s, 2, size(_s) - 1), (x, y) -> ((x ^ y) & ~_mask) = 0)")
    df = df.select("*", near.alias("_near"))
    twice = F.expr(
        f"""filter(sequence(0, size(_s) - 1),
              k -> (k < size(_s) - 1 and _near[k] and {_same_window("k", "k + 1")})
                or (k > 0 and _near[k - 1] and {_same_window("k - 1", "k")}))"""
    )
    df = df.select("*", F.when(F.array_contains("_near", True), twice).alias("_hits"))
    df = df.select("*", F.expr("sort_array(transform(_hits, k -> cast(_s[k] & _mask as int)))").alias("_p"))
    covered = F.expr(
        "aggregate(zip_with(_p, slice(_p, 2, size(_p)), (x, y) -> coalesce(least(3, y - x), 3)), 0L, (a, x) -> a + x)"
    )
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.select("*", F.when(F.size("_p") > 0, covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"), lines.alias("_lines"))
    df = df.withColumn("n_words", F.col("_n").cast("long"))

    def left(keep: str) -> Column:
        return F.char_length(F.regexp_replace("_text", keep, "")).cast("long")

    return df.select(
        *[c for c in df.columns if c not in ("_text", "_w", "_n", "_b", "_mask", "_s", "_near", "_hits", "_p", "_lines", "n_repeat_words", "n_words")],
        "n_words",
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        left(SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        F.size("_lines").cast("long").alias("n_lines"),
        left(r"\P{Lu}+").alias("n_upper"),
        left(r"[^!-/:-@\[-`{-~]+").alias("n_punct"),
    )


def _transformed(counts: DataFrame) -> DataFrame:
    """Variance-stabilised shares; zero for texts without words."""

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    return counts.select(
        "*",
        F.sqrt(share("n_symbols", "n_words")).alias("symbol_share"),
        F.sqrt(share("n_upper", "word_chars")).alias("upper_share"),
        F.sqrt(share("n_punct", "word_chars")).alias("punct_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        F.log(F.greatest(share("word_chars", "n_words"), F.lit(1.0))).alias("word_length"),
    )


def _decomposed(estimates: DataFrame) -> DataFrame:
    """Adds the Cholesky factor (l_i_j) of the scatter (c_i_j) and its log determinant, entry by entry."""
    for i, j in PAIRS:
        taken = reduce(lambda a, b: a + b, [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)], F.lit(0.0))
        rest = F.col(f"c_{i}_{j}") - taken
        # the tolerance keeps every pivot at or above its square
        entry = F.sqrt(F.greatest(rest, F.lit(STATISTICS[i][1] ** 2))) if i == j else rest / F.col(f"l_{j}_{j}")
        estimates = estimates.withColumn(f"l_{i}_{j}", entry)
    return estimates.withColumn("log_det", 2 * reduce(lambda a, b: a + b, [F.log(f"l_{i}_{i}") for i in range(D)]))


def _with_distance(df: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance by forward substitution with the factor l and the location m."""
    for i in range(D):
        rest = F.col(X[i]) - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        df = df.withColumn(f"z_{i}", rest / F.col(f"l_{i}_{i}"))
    total = reduce(lambda a, b: a + b, [F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(D)])
    return df.withColumn("distance", total).drop(*[f"z_{i}" for i in range(D)])


def _moments(weight: Column | None = None) -> list[Column]:
    def over(x: Column) -> Column:
        return F.avg(x if weight is None else F.when(weight, x))

    return [over(F.col(x)).alias(f"m_{i}") for i, x in enumerate(X)] + [
        over(F.col(X[i]) * F.col(X[j])).alias(f"q_{i}_{j}") for i, j in PAIRS
    ]


def _chi_squared(half: int, x: float) -> float:
    """Distribution function with 2 * ``half`` degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))


def consistency(core: float) -> float:
    """Scatter of all rows over that of the share ``core`` nearest to the middle, for normal rows."""
    if core >= 1:
        return 1.0
    low, high = 0.0, 1e3
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi_squared(D // 2, middle) < core else (low, middle)
    return core / _chi_squared(D // 2 + 1, low)


def _scatter(moments: DataFrame, *others: str, factor: float = 1.0) -> DataFrame:
    """Covariances from the mean products, times ``factor``, plus the tolerances."""
    entries = [
        (factor * (F.col(f"q_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")) + (STATISTICS[i][1] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}")
        for i, j in PAIRS
    ]
    return moments.select(*others, *[f"m_{i}" for i in range(D)], *entries)


def _estimates(rows: DataFrame, keys: list[str], core: float, steps: int) -> DataFrame:
    """One MCD estimate per key: m_i, c_i_j and the number of texts ``n``."""
    per = ["start", *keys]
    median = [F.percentile_approx(x, 0.5, 1000).alias(f"m_{i}") for i, x in enumerate(X)]
    quart = [F.percentile_approx(x, [0.25, 0.75], 1000).alias(f"r_{i}") for i, x in enumerate(X)]
    grouped = rows.groupBy(*keys).agg(F.count("*").alias("n"), *median, *quart)
    spread = [((F.col(f"r_{i}")[1] - F.col(f"r_{i}")[0]) / 1.349) for i in range(D)]
    robust = grouped.select(
        F.lit(0).alias("start"),
        *keys,
        *[f"m_{i}" for i in range(D)],
        *[((spread[i] * spread[i] + STATISTICS[i][1] ** 2) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in PAIRS],
    )
    plain = _scatter(rows.groupBy(*keys).agg(*_moments()).withColumn("start", F.lit(1)), *per)
    sizes = materialise(grouped.select(*keys, "n"), "mcd_sizes")
    narrow = F.broadcast if sizes.count() <= BROADCAST_GROUPS else lambda estimates: estimates
    current = materialise(_decomposed(robust.unionByName(plain)), "mcd_estimate")
    scale = consistency(core)
    for _ in range(steps):
        measured = _with_distance(rows.join(narrow(current), keys)).select("start", *keys, *X, "distance")
        limits = measured.groupBy(*per).agg(F.percentile_approx("distance", core, 1000).alias("limit"))
        limited = materialise(current.join(limits, per), "mcd_limits")
        nearest = _with_distance(rows.join(narrow(limited), keys)).filter("distance <= limit")
        current = materialise(_decomposed(_scatter(nearest.groupBy(*per).agg(*_moments()), *per, factor=scale)), "mcd_estimate")
    fitted = [f"m_{i}" for i in range(D)] + [f"c_{i}_{j}" for i, j in PAIRS]
    best = current.groupBy(*keys).agg(F.min_by(F.struct(*fitted), F.col("log_det")).alias("_best"))
    return best.select(*keys, "_best.*").join(sizes, keys)


def _blended(found: DataFrame, prior: float) -> DataFrame:
    """Per group the estimate of its texts and ``prior`` texts of the pooled estimate, decomposed."""
    is_every = (F.col("_lang") == EVERY) & (F.col("_source") == EVERY)
    fitted = [f"m_{i}" for i in range(D)] + [f"c_{i}_{j}" for i, j in PAIRS]
    general = F.broadcast(found.filter(is_every).select(F.struct(*fitted).alias("_all")))  # one row
    both = found.filter(~is_every).join(general, F.lit(True)).withColumn("_w", F.col("n") / (F.col("n") + F.lit(prior)))
    own, other = F.col("_w"), 1 - F.col("_w")
    apart = [F.col(f"m_{i}") - F.col(f"_all.m_{i}") for i in range(D)]
    blended = both.select(
        "_lang",
        "_source",
        *[(own * F.col(f"m_{i}") + other * F.col(f"_all.m_{i}")).alias(f"m_{i}") for i in range(D)],
        *[
            (own * F.col(f"c_{i}_{j}") + other * F.col(f"_all.c_{i}_{j}") + own * other * apart[i] * apart[j]).alias(f"c_{i}_{j}")
            for i, j in PAIRS
        ],
    )
    return _decomposed(blended).select("_lang", "_source", *[f"m_{i}" for i in range(D)], *[f"l_{i}_{j}" for i, j in PAIRS])


def outliers(counts: DataFrame, core: float = CORE, steps: int = STEPS, prior: float = PRIOR) -> DataFrame:
    """``counts`` (with ``_lang`` and ``_source``, written) with the column ``distance``."""
    rows = _transformed(counts)
    own = F.struct("_lang", "_source")
    every = F.struct(F.lit(EVERY).alias("_lang"), F.lit(EVERY).alias("_source"))
    fit = rows.filter("not base_failed").select(F.explode(F.array(own, every)).alias("_key"), *X)
    found = materialise(_estimates(fit.select("_key.*", *X), ["_lang", "_source"], core, steps), "mcd_groups")
    groups = materialise(_blended(found, prior), "mcd_blended")
    groups = F.broadcast(groups) if found.count() <= BROADCAST_GROUPS else groups
    joined = rows.join(groups, ["_lang", "_source"], "left").select(*rows.columns, *[c for c in groups.columns if c[0] != "_"])
    return _with_distance(joined).drop(*[c for c in groups.columns if c[0] != "_"], *X)


def _group_columns(*names: str) -> list[Column]:
    """Language and source; a null is a group of its own."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(a) for c, a in zip(names, ("_lang", "_source"), strict=True)]


def _verdict(cutoff: float) -> Column:
    return ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    cutoff: float = CUTOFF,
) -> DataFrame:
    """One row per input row: ``id_col``, the counts, base_failed, kept and the robust ``distance``."""
    counts = with_counts(
        docs,
        text_col,
        F.col(id_col).alias("_id"),
        *_group_columns(lang_col, source_col),
    )
    scored = outliers(materialise(counts, "quality_counts"))
    return scored.select(
        F.col("_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        _verdict(cutoff).alias("kept"),
        "distance",
    )


def keep_good(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    cutoff: float = CUTOFF,
) -> DataFrame:
    """The rows of ``docs``, all columns, that pass the base rules and the outlier test.

    Rows and counts are written once; the estimates read only the counts, and the verdict is taken while the
    rows are read again, so no row is joined by an id.
    """
    counts = with_counts(
        docs,
        text_col,
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        *_group_columns(lang_col, source_col),
    )
    scored = outliers(materialise(counts, "quality_rows"))
    return scored.filter(_verdict(cutoff)).select("_doc.*")
