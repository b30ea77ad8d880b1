"""Quality rules: base limits on counts, then robust multivariate outliers per language and source.

Each document has a vector of transformed statistics.  Per language and source, the minimum covariance
determinant is approached by concentration steps: measure every document's Mahalanobis distance under the
current mean and covariance, keep the share of documents that lie nearest, and estimate anew from those.
Documents beyond a quantile of the distances' expected distribution are rejected.  All of it is DataFrame
operations: counts come from array functions within a row, every step is a partially aggregated group-by, and what a step
hands to the next is one row per group, broadcast where Spark finds it small, so that rows are never dealt by group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedframe.llm.common import cut_lineage

BLANKS = "[\\x20\\x09-\\x0D]+"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Share of documents that estimates rest on, concentration steps, and documents that a group needs for its own estimate.
CORE_SHARE = 0.75
STEPS = 4
MIN_GROUP = 100
#: Documents of one multivariate normal group that would be rejected: one in a hundred thousand.
REJECT_SHARE = 1e-5
#: Spread that is always granted to each statistic, so that small rates pass where a statistic is the same everywhere.  Each
#: statistic can pass the limit by itself: a root of a rate does in a group without such cases above 0.285.
VECTOR = {"length": 0.1, "symbols": 0.1, "lines": 0.1, "repeats": 0.1}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
D = len(VECTOR)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words which occurs at least twice."""

    def over_windows(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        again = let(
            ordered,
            lambda o: F.array_sort(
                F.filter(
                    F.transform(
                        o,
                        lambda e, i: F.when((F.get(o, i - 1)["x"] == e["x"]) | (F.get(o, i + 1)["x"] == e["x"]), e["i"]),
                    ),
                    lambda i: i.isNotNull(),
                )
            ),
        )
        # Starts in order: each adds its three words less those that the next start covers.
        covered = let(
            again,
            lambda r: F.aggregate(
                F.transform(r, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(r, k + 1) - s, F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x
            ),
        )
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered)

    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)),
    )
    return let(windows, over_windows)


def measured(text: Column) -> Column:
    """Struct of the base counts of a whole text, null read as empty, and its lines with a word."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(
        F.struct(words_of(text).alias("w"), lines.alias("l"), text.alias("t")),
        lambda v: F.struct(
            F.size(v["w"]).cast("long").alias("n_words"),
            F.length(F.array_join(v["w"], "")).cast("long").alias("word_chars"),
            (F.length(v["t"]) - F.length(F.regexp_replace(v["t"], "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            (F.size(v["l"]) - F.size(F.array_distinct(v["l"]))).cast("long").alias("n_dup_lines"),
            repeated_words(v["w"]).alias("n_repeat_words"),
            F.size(v["l"]).cast("long").alias("n_lines"),
        ),
    )


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words)


def vector(m: Column) -> dict[str, Column]:
    """Transformed statistics: logarithm of the mean word length and square roots of rates."""
    words = F.greatest(m["n_words"], F.lit(1))
    return {
        "length": F.log(F.greatest(m["word_chars"], F.lit(1)) / words),
        "symbols": F.sqrt(m["n_symbols"] / words),
        "lines": F.sqrt(m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1))),
        "repeats": F.sqrt(m["n_repeat_words"] / words),
    }


def chi_square_share(x: float, pairs: int) -> float:
    """P(chi-square with 2 * pairs degrees of freedom <= x)."""
    term, total = 1.0, 1.0
    for k in range(1, pairs):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(share: float, pairs: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_share(mid, pairs) < share else (low, mid)
    return high


def grouped(stats: DataFrame, language: str, source: str) -> DataFrame:
    """Adds ``_g``: language and source, where these have too few documents the language, else all that remain."""
    own = stats.groupBy(F.col(language).alias("_l"), F.col(source).alias("_s")).agg(F.count_if("_used").alias("_n"))
    small = F.col("_n") < MIN_GROUP
    pooled = own.filter(small).groupBy(F.col("_l").alias("_pl")).agg(F.sum("_n").alias("_pn"))
    key = lambda level, *parts: F.concat_ws("\x1f", F.lit(level), *[F.coalesce(F.concat(F.lit("="), p), F.lit("null")) for p in parts])
    groups = own.join(pooled, F.col("_l").eqNullSafe(F.col("_pl")), "left").select(
        "_l",
        "_s",
        F.when(~small, key("source", F.col("_l"), F.col("_s"))).when(F.col("_pn") >= MIN_GROUP, key("language", F.col("_l"))).otherwise(F.lit("all")).alias("_g"),
    )
    # One row per language and source; written, so that Spark sees its size before it chooses a join.
    groups = cut_lineage(groups)
    return stats.join(groups, F.col(language).eqNullSafe(F.col("_l")) & F.col(source).eqNullSafe(F.col("_s"))).drop("_l", "_s")


def estimates(rows: DataFrame) -> DataFrame:
    """Per group the mean (m0..) and the inverse of the covariance's lower triangular root (i00, i10, i11, ..).

    A group with fewer than ``MIN_GROUP`` documents gives no estimate.
    """
    x = [F.col(f"_x{i}") for i in range(D)]
    sums = [F.avg(x[i]).alias(f"m{i}") for i in range(D)]
    sums += [F.covar_pop(x[i], x[j]).alias(f"c{i}{j}") for i in range(D) for j in range(i + 1)]
    out = rows.groupBy("_g").agg(F.count("*").alias("_n"), *sums)
    floors = list(VECTOR.values())
    for i in range(D):
        for j in range(i + 1):
            held = F.col(f"c{i}{j}") / core_factor() if i != j else F.col(f"c{i}{j}") / core_factor() + floors[i] ** 2
            rest = held - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    for i in range(D):
        for j in range(i + 1):
            rest = F.lit(1.0 if i == j else 0.0) - sum((F.col(f"l{i}{k}") * F.col(f"i{k}{j}") for k in range(j, i)), F.lit(0.0))
            out = out.withColumn(f"i{i}{j}", rest / F.col(f"l{i}{i}"))
    return out.select("_g", "_n", *[f"m{i}" for i in range(D)], *[f"i{i}{j}" for i in range(D) for j in range(i + 1)])


def core_factor() -> float:
    """Variance of the nearest ``CORE_SHARE`` of a normal group, as a share of the group's."""
    return chi_square_share(chi_square_quantile(CORE_SHARE, D // 2), D // 2 + 1) / CORE_SHARE


def distance(model_prefix: str = "") -> Column:
    """Squared Mahalanobis distance of _x0.. under the joined estimate."""
    m = lambda name: F.col(f"{model_prefix}{name}")
    parts = [sum((m(f"i{i}{j}") * (F.col(f"_x{j}") - m(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(D)]
    return sum((p * p for p in parts), F.lit(0.0))


def fit(stats: DataFrame) -> DataFrame:
    """Estimates per group, one small row each, from all documents that pass the base limits."""
    rows = stats.filter("_used").select("_g", *[f"_x{i}" for i in range(D)])
    model = cut_lineage(estimates(rows))
    for _ in range(STEPS):
        near = rows.join(model, "_g").select("_g", *[f"_x{i}" for i in range(D)], distance().alias("_d"))
        # The distance that encloses the core, from counts of finely binned distances.
        bins = near.groupBy("_g", F.floor(F.log2(F.col("_d") + 1e-9) * 64).alias("_b")).agg(F.count("*").alias("_c"))
        held = bins.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_b", "_c"))).alias("_bins"), F.sum("_c").alias("_all"))
        reach = F.aggregate(
            "_bins",
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("b")),
            lambda a, e: F.struct((a["n"] + e["_c"]).alias("n"), F.when(a["n"] < F.col("_all") * CORE_SHARE, e["_b"]).otherwise(a["b"]).alias("b")),
        )
        # One row per group: with its size known Spark broadcasts it, and rows stay where they are.
        cuts = cut_lineage(held.select("_g", reach["b"].alias("_cut")))
        core = near.join(cuts, "_g").filter(F.floor(F.log2(F.col("_d") + 1e-9) * 64) <= F.col("_cut"))
        model = cut_lineage(estimates(core))
    return model


def judge(docs: DataFrame, text: str = "text", language: str = "lang", source: str = "source", keep: Sequence[str] | None = None) -> DataFrame:
    """Each row of ``docs`` (its columns ``keep``, all by default) with the base counts, base_failed, the squared ``distance`` and ``kept``.

    Null and empty texts have no words and fail the base limits.  A null language or source is a group like any
    other.  Groups of fewer than ``MIN_GROUP`` usable documents are pooled by language, then altogether; if even
    that is too small, only the base limits decide and ``distance`` is null.  Repeated rows count and are judged
    one by one, texts are read whole whatever their length, an empty table gives an empty one, and columns of
    the result's names are replaced.
    """
    added = [*COUNTS, "base_failed", "distance", "kept"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    # Texts are measured once; the copy holds the counts next to the columns that are kept.
    stats = cut_lineage(_stats(docs, names, text, language, source))
    return _judged(stats, names)


def _stats(docs: DataFrame, names: list[str], text: str, language: str, source: str) -> DataFrame:
    held = docs.select(*[F.col(f"`{c}`") for c in names], F.col(language).alias("_lang"), F.col(source).alias("_source"), measured(F.col(text)).alias("_m"))
    flagged = held.withColumn("_failed", base_failed(F.col("_m.n_words"), F.col("_m.n_repeat_words")))
    x = vector(F.col("_m"))
    return flagged.select("*", (~F.col("_failed")).alias("_used"), *[x[n].alias(f"_x{i}") for i, n in enumerate(VECTOR)])


def _judged(stats: DataFrame, names: list[str]) -> DataFrame:
    basis = cut_lineage(grouped(stats.select("_lang", "_source", "_used", *[f"_x{i}" for i in range(D)]), "_lang", "_source"))
    model = fit(basis)
    keys = basis.select("_lang", "_source", "_g").distinct()
    groups = cut_lineage(keys.join(model, "_g").select(F.col("_lang").alias("_ml"), F.col("_source").alias("_ms"), *[F.col(c) for c in model.columns if c != "_g"]))
    own = F.col("_lang").eqNullSafe(F.col("_ml")) & F.col("_source").eqNullSafe(F.col("_ms"))
    out = stats.join(groups, own, "left")
    verdict = F.when((F.col("_n") >= MIN_GROUP * CORE_SHARE) & ~F.col("_failed"), distance())
    limit = chi_square_quantile(1 - REJECT_SHARE, D // 2)
    return out.withColumn("_d", verdict).select(
        *[F.col(f"`{c}`") for c in names],
        *[F.col(f"_m.{c}").alias(c) for c in COUNTS],
        F.col("_failed").alias("base_failed"),
        F.col("_d").alias("distance"),
        (~F.col("_failed") & F.coalesce(F.col("_d") <= limit, F.lit(True))).alias("kept"),
    )
