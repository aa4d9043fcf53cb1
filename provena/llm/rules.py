"""Quality rules with robust multivariate outliers. DataFrame functions only.

Text statistics come from one narrow pass over whole texts. A transformed vector of them is then
compared with the other documents of its language and source: three deterministic starts around the
medians are each led through concentration steps (take the SHARE of the group nearest to the current
centre, re-estimate centre and covariance); of the covariances reached, that of least determinant
is the group's estimate, rescaled to be consistent at the normal distribution; documents beyond a
Mahalanobis distance are rejected. Each step is one
grouped aggregation with map-side sums. Medians and quantiles are read from counts of fixed-width
bins, so a hot group is never sorted or gathered.

Defined results: a null or empty text has no words, zero statistics and fails the base rule; null
language or source is a group of its own; groups of fewer than LEAST rows are pooled, and if the
pool is as small it rejects nothing; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import staged

SPACE = r"\x20\x09-\x0D"
#: Share of a group that the estimate rests on; rows of the smallest group with an estimate of its own; concentration steps.
SHARE, LEAST, STEPS = 0.75, 60, 3
#: Quantile of the chi-squared distribution with five degrees of freedom at SHARE, by which distances are made consistent.
CHI2_SHARE = 6.6257
#: Squared distance beyond which a document is rejected: the chi-squared quantile at 1 - 1e-8 with five degrees of freedom, rounded up.
REJECT = 46.0
#: Least standard deviation of each transformed statistic: log words, log word length, log symbols per hundred words, repeated and duplicated shares.
FLOORS = (0.6, 0.12, 0.5, 0.1, 0.1)
BINS = 64  # of a unit


def _pairs(items: Column) -> Column:
    """Neighbours of an array as an array of (left, right) structs; empty for fewer than two."""
    n = F.size(items)
    return F.arrays_zip(F.slice(items, 1, F.greatest(n - 1, F.lit(0))).alias("left"), F.slice(items, 2, F.greatest(n - 1, F.lit(0))).alias("right"))


def repeat_words(words: Column, n: int = 5) -> Column:
    """Words that lie in an n-word window found twice or more in the array."""
    starts = F.sequence(F.lit(1), F.size(words) - F.lit(n - 1))
    windows = F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice(words, i, n)).alias("h"), i.alias("at")))
    some = F.when(F.size(words) > n, windows).otherwise(F.expr("cast(array() as array<struct<h:bigint,at:int>>)"))

    def covered(found: Column) -> Column:
        """found: all windows in order of hash. Positions with an equal neighbour, then the words they cover."""
        twice = F.filter(_pairs(found), lambda p: p["left"]["h"] == p["right"]["h"])
        at = F.array_sort(F.array_distinct(F.concat(F.transform(twice, lambda p: p["left"]["at"]), F.transform(twice, lambda p: p["right"]["at"]))))
        # Lambda variables, not columns: each array is evaluated once for a row.
        return F.element_at(F.transform(F.array(at), lambda a: F.aggregate(_pairs(a), F.when(F.size(a) > 0, F.lit(n)).otherwise(0).cast("long"), lambda total, p: total + F.least(F.lit(n), p["right"] - p["left"]))), 1)

    def of(found: Column) -> Column:
        same = F.size(F.array_distinct(F.transform(found, lambda w: w["h"]))) == F.size(found)
        return F.when(same, F.lit(0).cast("long")).otherwise(F.element_at(F.transform(F.array(F.array_sort(found)), covered), 1))

    return F.element_at(F.transform(F.array(some), of), 1)


def statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """A row for each document: id, the columns of by, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]"))
    words = F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))
    rows = documents.select(
        F.col(id_col).alias("__id"),
        *[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)],
        F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.element_at(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 1).cast("long").alias("n_dup_lines"),
        F.element_at(F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r"))), 1).alias("__w"),
    )
    n, r = F.col("__w.n"), F.col("__w.r")
    return rows.select("__id", *[f"__by{k}" for k in range(len(by))], n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", r.alias("n_repeat_words"), ((n < 10) | (100 * r > 20 * n)).alias("base_failed"))


def transformed() -> list[Column]:
    """The vector of a document, in the order of FLOORS; rounded, so that sums of it are exact in any order."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    values = [F.log1p("n_words"), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words), F.log1p(100 * F.col("n_symbols") / words), F.col("n_repeat_words") / words, F.log1p(F.col("n_dup_lines")) / F.log1p(F.col("n_dup_lines") + 10)]
    return [F.round(v * 1024) / 1024 for v in values]


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _quantile(df: DataFrame, keys: list[str], value: Column, share: float, name: str) -> DataFrame:
    """(keys, name): upper edge of the bin of value at which the share of a group's rows is reached."""
    bins = df.groupBy(*keys, F.floor(F.least(value, F.lit(1e6)) * BINS).alias("__bin")).agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*keys)
    upto = bins.withColumn("__upto", F.sum("__n").over(group.orderBy("__bin"))).withColumn("__all", F.sum("__n").over(group))
    return upto.where(F.col("__upto") >= F.lit(share) * F.col("__all")).groupBy(*keys).agg(((F.min("__bin") + 1) / BINS).alias(name))


def _distance(p: int) -> Column:
    """Squared Mahalanobis distance of __z from __centre under the inverse Cholesky factor __factor, its rows one after another."""
    def row(i: int) -> Column:
        return _total([F.col("__factor")[i * p + j] * (F.col("__z")[j] - F.col("__centre")[j]) for j in range(i + 1)])

    return _total([F.pow(row(i), 2) for i in range(p)])


def _inverse_factor(df: DataFrame, p: int) -> DataFrame:
    """Adds __factor, the inverse of the Cholesky factor of the covariance in columns c{i}_{j}, j <= i."""
    for i in range(p):
        for j in range(i + 1):
            inner = F.col(f"c{i}_{j}") - _total([F.lit(0.0)] + [F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)])
            df = df.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(inner, F.lit(1e-9))) if i == j else inner / F.col(f"l{j}_{j}"))
    for i in range(p):
        for j in range(i + 1):
            inner = F.lit(1.0 if i == j else 0.0) - _total([F.lit(0.0)] + [F.col(f"l{i}_{k}") * F.col(f"v{k}_{j}") for k in range(j, i)])
            df = df.withColumn(f"v{i}_{j}", inner / F.col(f"l{i}_{i}"))
    return df.withColumn("__factor", F.array(*[F.col(f"v{i}_{j}") if j <= i else F.lit(0.0) for i in range(p) for j in range(p)]))


def _with(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    return rows.join(estimates.withColumnRenamed("__group", "__g"), F.col("__group") == F.col("__g")).drop("__g")


def _moments(sums: DataFrame, p: int, keys: list[str]) -> DataFrame:
    """(keys, __centre, c{i}_{j}) from counts n, sums s{i} and sums of products q{i}_{j}."""
    covariance = [(F.col(f"q{i}_{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / (F.col("n") * F.col("n"))).alias(f"c{i}_{j}") for i in range(p) for j in range(i + 1)]
    return sums.select(*keys, F.array(*[F.col(f"s{i}") / F.col("n") for i in range(p)]).alias("__centre"), *covariance)


def _sums(vector: str, p: int, prefix: str = "") -> list[Column]:
    v = F.col(vector)
    return [F.count(F.lit(1)).alias(f"{prefix}n"), *[F.sum(v[i]).alias(f"{prefix}s{i}") for i in range(p)], *[F.sum(v[i] * v[j]).alias(f"{prefix}q{i}_{j}") for i in range(p) for j in range(i + 1)]]


def _with_floors(df: DataFrame, p: int, scale: Column | None = None) -> DataFrame:
    """The covariance times scale, and the least variances beside it: they grow with the scale and never shrink."""
    k = F.lit(1.0) if scale is None else scale
    return df.withColumns({f"c{i}_{i}": k * F.col(f"c{i}_{i}") + F.greatest(k, F.lit(1.0)) * FLOORS[i] ** 2 for i in range(p)} | {f"c{i}_{j}": k * F.col(f"c{i}_{j}") for i in range(p) for j in range(i)})


def starts(rows: DataFrame, p: int) -> DataFrame:
    """(__group, __start, __centre, __factor): three deterministic estimates of each group, all around the medians.

    0: spreads by median deviation, no correlation. 1: correlation of the hyperbolic tangents of the
    standardised vectors. 2: correlation of their spatial signs. Far rows weigh little in any of them.
    """
    axes = rows.select("__group", F.posexplode("__z").alias("__axis", "__v"))
    middle = _quantile(axes, ["__group", "__axis"], F.col("__v"), 0.5, "__mid")
    away = axes.withColumnsRenamed({"__group": "__g", "__axis": "__a"}).join(middle, (F.col("__g") == F.col("__group")) & (F.col("__a") == F.col("__axis")))
    floors = F.array(*map(F.lit, FLOORS))
    spread = _quantile(away.select("__group", "__axis", F.col("__mid"), F.abs(F.col("__v") - F.col("__mid")).alias("__v")), ["__group", "__axis", "__mid"], F.col("__v"), 0.5, "__mad")
    # One small row for each axis of a group.
    placed = spread.groupBy("__group").agg(F.array_sort(F.collect_list(F.struct("__axis", "__mid", F.greatest(F.col("__mad") * 1.4826, floors[F.col("__axis")]).alias("__s")))).alias("__p"))
    placed = staged(placed.select("__group", F.transform("__p", lambda x: x["__mid"]).alias("__centre"), F.transform("__p", lambda x: x["__s"]).alias("__spread")), "rules-start")

    units = _with(rows, placed).withColumn("__u", F.array(*[(F.col("__z")[i] - F.col("__centre")[i]) / F.col("__spread")[i] for i in range(p)]))
    length = F.sqrt(_total([F.pow(F.col("__u")[i], 2) for i in range(p)]))
    exact = lambda v: F.round(v * 1024) / 1024  # noqa: E731  sums of such values are the same in any order
    units = units.select("__group", F.transform("__u", lambda u: exact(F.tanh(u))).alias("__tanh"), F.transform("__u", lambda u: F.when(length > 0, exact(u / length)).otherwise(0.0)).alias("__sign"))
    shapes = units.groupBy("__group").agg(*_sums("__tanh", p, "t"), *_sums("__sign", p, "u"))
    both = staged(shapes.join(placed.withColumnRenamed("__group", "__g"), F.col("__group") == F.col("__g")).drop("__g"), "rules-shapes")

    def of(start: int, correlation: Callable[[int, int], Column]) -> DataFrame:
        spreads = lambda i, j: F.col("__spread")[i] * F.col("__spread")[j]
        return both.select("__group", F.lit(start).alias("__start"), "__centre", *[(spreads(i, j) * (F.lit(1.0) if i == j else correlation(i, j))).alias(f"c{i}_{j}") for i in range(p) for j in range(i + 1)])

    def of_sums(prefix: str, centred: bool) -> Callable[[int, int], Column]:
        n = F.col(f"{prefix}n")
        shared = lambda i, j: F.col(f"{prefix}q{i}_{j}") / n - (F.col(f"{prefix}s{i}") * F.col(f"{prefix}s{j}") / (n * n) if centred else F.lit(0.0))
        # A tenth is taken off each correlation, so that the matrix stays well away from singular.
        return lambda i, j: F.coalesce(0.9 * shared(i, j) / F.nullif(F.sqrt(F.greatest(shared(i, i) * shared(j, j), F.lit(0.0))), F.lit(0.0)), F.lit(0.0))

    every = of(0, lambda i, j: F.lit(0.0)).unionByName(of(1, of_sums("t", True))).unionByName(of(2, of_sums("u", False)))
    return _inverse_factor(every, p).select("__group", "__start", "__centre", "__factor")


def concentrated(rows: DataFrame, p: int, steps: int = STEPS) -> DataFrame:
    """(__group, __start, __centre, __factor, c{i}_{j}, __logdet): each start after so many concentration steps.

    c is the covariance of the nearest SHARE; __factor and __logdet are of c with the least variances.
    """
    keys = ["__group", "__start"]
    now = staged(starts(rows, p), "rules-starts")
    for step in range(steps):
        near = _with(rows, now).withColumn("__d", F.log1p(_distance(p)))
        cut = _quantile(near, keys, F.col("__d"), SHARE, "__cut").withColumnsRenamed({"__group": "__g", "__start": "__s"})
        kept = near.join(cut, (F.col("__group") == F.col("__g")) & (F.col("__start") == F.col("__s"))).where("__d <= __cut")
        moments = _moments(kept.groupBy(*keys).agg(*_sums("__z", p)), p, keys)
        raw = [f"c{i}_{j}" for i in range(p) for j in range(i + 1)]
        firm = _inverse_factor(_with_floors(moments.withColumn("__raw", F.struct(*raw)), p), p)
        logdet = _total([2 * F.log(f"l{i}_{i}") for i in range(p)])
        now = staged(firm.select(*keys, "__centre", "__factor", *[F.col(f"__raw.{c}").alias(c) for c in raw], logdet.alias("__logdet")), f"rules-step{step}")
    return now


def least_of(rows: DataFrame, every: DataFrame, p: int) -> DataFrame:
    """(__group, __start, __logdet, __centre, __factor) of each group of rows (__group, __z): of its concentrated starts (every) the one of least determinant, made consistent.

    The covariance is multiplied so that SHARE of the rows lie where the chi-squared distribution has
    them, up or down; the least variances never shrink.
    """
    columns = [c for c in every.columns if c != "__group"]
    least = every.groupBy("__group").agg(F.min_by(F.struct(*columns), F.struct(F.round("__logdet", 9), "__start")).alias("b")).select("__group", "b.*")
    least = staged(least, "rules-least")
    reached = _quantile(_with(rows, least).withColumn("__d", F.log1p(_distance(p))), ["__group"], F.col("__d"), SHARE, "__at")
    scaled = _with_floors(_with(least, reached), p, F.expm1("__at") / CHI2_SHARE)
    return _inverse_factor(scaled, p).select("__group", "__start", "__logdet", "__centre", "__factor")


def estimates(rows: DataFrame, p: int, steps: int = STEPS) -> DataFrame:
    """least_of() the concentrated starts of rows (__group, __z)."""
    return least_of(rows, concentrated(rows, p, steps), p)


def apply_rules(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source"), reject: float = REJECT) -> DataFrame:
    """statistics() with distance (squared, null without an estimate) and kept: false if base_failed or distance > reject."""
    stats = staged(statistics(documents, id_col, text_col, by), "rules-statistics")
    keys = [f"__by{k}" for k in range(len(by))]
    # A group's key as text that null and any value tell apart.
    named = stats.withColumn("__name", F.to_json(F.struct(*keys))).withColumn("__z", F.array(*transformed()))
    counts = named.where("not base_failed").groupBy("__name").agg(F.count(F.lit(1)).alias("__n"))
    groups = staged(counts.select("__name", F.when(F.col("__n") >= LEAST, F.col("__name")).otherwise("pooled").alias("__group"), "__n"), "rules-groups")
    large = groups.groupBy("__group").agg(F.sum("__n").alias("__n")).where(F.col("__n") >= LEAST).select(F.col("__group").alias("__large"))
    placed = named.join(groups.select(F.col("__name").alias("__own"), "__group"), F.col("__name") == F.col("__own"), "left").drop("__own")
    rows = placed.where("not base_failed").join(large, F.col("__group") == F.col("__large"), "left_semi").select("__group", "__z")
    p = len(FLOORS)
    fitted = staged(estimates(rows, p).select("__group", "__centre", "__factor"), "rules-estimates")
    judged = placed.join(fitted.withColumnRenamed("__group", "__g"), F.col("__group") == F.col("__g"), "left")
    distance = _distance(p)
    kept = ~F.col("base_failed") & F.coalesce(distance <= reject, F.lit(True))
    return judged.select(F.col("__id").alias(id_col), *[F.col(k).alias(c) for k, c in zip(keys, by)], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"), kept.alias("kept"))
