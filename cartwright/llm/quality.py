"""Quality rules: fixed rules, then robust multivariate outliers per language and source.

Every text gives a vector of five transformed statistics (``TRAITS``), each divided by the
least spread that shall count. For each group the minimum-covariance-determinant estimate
is found by concentration steps: of all rows of the group, the half with the smallest
Mahalanobis distances gives the next centre and covariance. Two starts run side by side, and
the one that ends with the smaller determinant is taken, reweighted once, and all rows are
measured by it. A unit ridge on the covariance keeps it regular where more than half of a
group agree in a statistic, and keeps small groups from rejecting what is merely unlike.

All is SQL functions. Vectors are integers (fixed point), so all sums are exact and no result
depends on the partitioning. The h-th smallest distance is found by counting distances in
bins of a sixteenth of an octave; the half ends with a whole bin.
"""

from __future__ import annotations

from math import erf, exp, gamma, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartwright.sources.staging import stage

#: White space between words; the contract's own class.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOL = "[#*$%&|<>]"
LEAST_WORDS = 50
#: Rejected if more than so many of a hundred words stand in repeated windows.
MOST_REPEATED = 50

#: Statistic and the spread that one unit of its coordinate stands for.
TRAITS = {
    "ln_words": 1.5,
    "ln_word_length": 0.12,
    "sqrt_symbol_share": 0.05,
    "sqrt_dup_line_share": 0.25,
    "sqrt_repeat_share": 0.25,
}
D = len(TRAITS)
#: Fixed-point units of a coordinate.
UNIT = 1024
#: Share of a group that a concentration step keeps.
HALF = 0.5
STEPS = 8
STARTS = ("unit", "spread")
#: Chance of a normal vector to be left out when the estimate is reweighted, and to be rejected.
REWEIGHT_TAIL = 0.025
REJECT_TAIL = 1e-5
#: Bins of squared distance in an octave.
BINS = 16

PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def chi2_cdf(x: float, df: int) -> float:
    """Distribution function of chi-square with an odd number of degrees of freedom."""
    value = erf(sqrt(x / 2))
    for k in range(1, df, 2):
        value -= (x / 2) ** (k / 2) * exp(-x / 2) / gamma(k / 2 + 1)
    return value


def chi2_quantile(p: float, df: int = D) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, df) < p else (low, middle)
    return low


def consistency(p: float) -> float:
    """What the covariance of the nearest share ``p`` of normal vectors falls short by."""
    return p / chi2_cdf(chi2_quantile(p), D + 2)


def _with(value: Column, function) -> Column:
    """``function`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), function)[0]


def _covered(places: Column) -> Column:
    """Words in the three-word windows that start at ``places``, which are sorted."""
    return F.aggregate(
        F.transform(
            places,
            lambda i, q: F.least(F.lit(3), F.coalesce(F.get(places, q + 1) - i, F.lit(3))),
        ),
        F.lit(0),
        lambda total, x: total + x,
    )


def _repeated_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more.

    Texts whose windows all hash apart have none. In others the windows are sorted by hash,
    so equal ones are neighbours, whose words are compared. Only if unequal neighbours share
    a hash, windows are sorted by hash and words instead.
    """

    def window(i: Column) -> list[Column]:
        return [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]

    def same_words(i: Column, j: Column) -> Column:
        a, b, c = (x == y for x, y in zip(window(i), window(j)))
        return a & b & c

    def marked(rows: Column) -> Column:
        """The start of each row whose neighbour has its hash; -2 where the words differ."""

        def mark(x: Column, q: Column) -> Column:
            before, after = F.get(rows, q - 1), F.get(rows, q + 1)
            like = [F.coalesce(x["h"] == y["h"], F.lit(False)) for y in (before, after)]
            same = [same_words(x["i"], y["i"]) for y in (before, after)]
            clash = (like[0] & ~same[0]) | (like[1] & ~same[1])
            return F.when(clash, -2).when(like[0] | like[1], x["i"]).otherwise(-1)

        return F.transform(rows, mark)

    def sorted_by(parts) -> Column:
        at = F.sequence(F.lit(0), F.size(words) - 3)
        return F.sort_array(F.transform(at, lambda i: F.struct(*parts(i))))

    def full(i: Column) -> list[Column]:
        a, b, c = window(i)
        return [F.xxhash64(a, b, c).alias("h"), *[x.alias(k) for x, k in ((a, "a"), (b, "b"), (c, "c"))], i.alias("i")]

    def starts_by_words(rows: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return F.coalesce(same_words(x["i"], y["i"]), F.lit(False))

        found = F.transform(
            rows,
            lambda x, q: F.when(
                same(x, F.get(rows, q - 1)) | same(x, F.get(rows, q + 1)), x["i"]
            ).otherwise(-1),
        )
        return _with(F.sort_array(F.filter(found, lambda i: i >= 0)), _covered)

    def count(marks: Column) -> Column:
        places = F.sort_array(F.filter(marks, lambda i: i >= 0))
        by_words = _with(sorted_by(full), starts_by_words)
        return F.when(F.array_contains(marks, -2), by_words).otherwise(_with(places, _covered))

    def of_hashes(hashes: Column) -> Column:
        rows = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        many = _with(F.sort_array(rows), lambda r: _with(marked(r), count))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(many)

    at = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(at, lambda i: F.xxhash64(*window(i)))
    return F.when(F.size(words) < 4, 0).otherwise(_with(hashes, of_hashes)).cast("long")


def text_statistics(docs: DataFrame, text_column: str, keep: list[Column]) -> DataFrame:
    """``keep``, ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, ``base_failed``.

    ``n_lines`` counts lines with words.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))

    def of_lines(lines: Column) -> Column:
        filled = F.filter(lines, lambda x: F.btrim(x, F.lit(BLANKS)) != "")
        return _with(
            filled,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            ),
        )

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeated_words(words).alias("n_repeat_words"),
        )

    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+", -1)
    )
    found = docs.select(
        *keep,
        _with(words, of_words).alias("own"),
        _with(F.split(text, "\n", -1), of_lines).alias("lines"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
    )
    n, repeated = F.col("own.n_words"), F.col("own.n_repeat_words")
    failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
    return found.select("*", "own.*", "lines.*", failed.alias("base_failed")).drop("own", "lines")


def vector(traits: dict[str, float] = TRAITS) -> list[Column]:
    """The coordinates ``z0, z1, ..`` in fixed point; null in rows without words."""
    transformed = {
        "ln_words": F.log(F.col("n_words").cast("double")),
        "ln_word_length": F.log(F.try_divide("word_chars", "n_words")),
        "sqrt_symbol_share": F.sqrt(F.try_divide("n_symbols", "word_chars")),
        "sqrt_dup_line_share": F.sqrt(F.try_divide("n_dup_lines", "n_lines")),
        "sqrt_repeat_share": F.sqrt(F.try_divide("n_repeat_words", "n_words")),
    }
    return [
        F.round(transformed[name] / spread * UNIT).cast("long").alias(f"z{i}")
        for i, (name, spread) in enumerate(traits.items())
    ]


def distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance of ``z*`` from ``mu*`` by the Cholesky factor ``l*``."""
    solved: list[Column] = []
    for i in range(D):
        rest = F.col(f"z{i}") - F.col(f"{prefix}mu{i}")
        for j in range(i):
            rest = rest - F.col(f"{prefix}l{i}{j}") * solved[j]
        solved.append(rest / F.col(f"{prefix}l{i}{i}"))
    total = solved[0] * solved[0]
    for y in solved[1:]:
        total = total + y * y
    return total


def binned(squared: Column) -> Column:
    """Bin of a squared distance; from 2^-10 on, ``BINS`` in an octave."""
    return F.floor(F.log2(F.greatest(squared, F.lit(2.0**-10))) * BINS).cast("int")


def _sums() -> list[Column]:
    def exact(value: Column) -> Column:
        return F.sum(value.cast("decimal(18,0)"))

    firsts = [exact(F.col(f"z{i}")).alias(f"s{i}") for i in range(D)]
    products = [exact(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"p{i}{j}") for i, j in PAIRS]
    return [F.count(F.lit(1)).alias("n"), *firsts, *products]


SUMS = ["n", *[f"s{i}" for i in range(D)], *[f"p{i}{j}" for i, j in PAIRS]]


def _estimates(sums: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """``keys, mu*, l*, volume``: centre, Cholesky factor and log determinant.

    The covariance is multiplied by ``factor`` and gets the unit ridge.
    """
    n = F.col("n").cast("double")
    mean = {i: F.col(f"s{i}").cast("double") / n for i in range(D)}
    centred = sums.select(
        *keys,
        *[mean[i].alias(f"mu{i}") for i in range(D)],
        *[
            (
                (F.col(f"p{i}{j}").cast("double") / n - mean[i] * mean[j]) * factor
                + (float(UNIT * UNIT) if i == j else 0.0)
            ).alias(f"c{i}{j}")
            for i, j in PAIRS
        ],
    )
    return _factored(centred, keys)


def _factored(centred: DataFrame, keys: list[str]) -> DataFrame:
    """Cholesky's factor of ``c*``, one row of it after the other."""
    means = [f"mu{i}" for i in range(D)]
    for i in range(D):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # rounding can't make a diagonal smaller than the ridge
            value = F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}{j}")
            centred = centred.withColumn(f"l{i}{j}", value)
    volume = F.log(F.col("l00"))
    for i in range(1, D):
        volume = volume + F.log(F.col(f"l{i}{i}"))
    factors = [f"l{i}{j}" for i, j in PAIRS]
    return centred.select(*keys, *means, *factors, volume.alias("volume"))


def _starts(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and start: the medians, with unit spread and with median deviations."""
    medians = vectors.groupBy(*keys).agg(
        *[F.percentile(f"z{i}", 0.5).alias(f"mu{i}") for i in range(D)]
    )
    deviation = {i: F.abs(F.col(f"z{i}") - F.col(f"mu{i}")) for i in range(D)}
    spread = (
        _measured_by(vectors, medians, keys)
        .groupBy(*keys, *[f"mu{i}" for i in range(D)])
        .agg(*[F.percentile(deviation[i], 0.5).alias(f"d{i}") for i in range(D)])
    )
    rows = []
    for start in STARTS:
        covariance = {
            (i, j): (
                F.lit(0.0)
                if i != j
                else F.lit(float(UNIT * UNIT))
                + (F.pow(F.col(f"d{i}") * 1.4826, F.lit(2.0)) if start == "spread" else 0.0)
            )
            for i, j in PAIRS
        }
        rows.append(
            spread.select(
                *keys,
                F.lit(start).alias("start"),
                *[F.col(f"mu{i}").cast("double").alias(f"mu{i}") for i in range(D)],
                *[covariance[p].cast("double").alias(f"c{p[0]}{p[1]}") for p in PAIRS],
            )
        )
    return _factored(rows[0].unionByName(rows[1]), [*keys, "start"])


def _measured_by(vectors: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Each vector with the row of its group; equal nulls match.

    Spark broadcasts the table of groups where it is small, and splits large groups of
    vectors where it is not.
    """
    own = table.select(*[F.col(k).alias(f"of_{k}") for k in keys], *[
        c for c in table.columns if c not in keys
    ])
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    return vectors.join(own, condition).drop(*[f"of_{k}" for k in keys])


def _nearest_half(binned_sums: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over the nearest bins that hold at least ``HALF`` of the rows of ``keys``."""
    group = W.partitionBy(*keys)
    before = F.sum("n").over(
        group.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    )
    total = F.sum("n").over(group)
    kept = binned_sums.withColumns(
        {"before": F.coalesce(before, F.lit(0)), "total": total}
    ).where(F.col("before") < F.ceil(F.col("total") * HALF))
    return kept.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def fit_groups(vectors: DataFrame, keys: list[str], steps: int = STEPS) -> DataFrame:
    """``keys, mu*, l*``: the reweighted minimum-covariance-determinant estimate of each group.

    A concentration step reads all vectors once: sums are taken per group, start and bin of
    the distance, merged in each task first, and the bins of the nearest half added up. A
    step's estimates (one row a group and start) are written to the shared folder.
    """
    both = [*keys, "start"]
    found = stage(_starts(vectors, keys), "quality-starts")
    for _ in range(steps):
        sums = (
            _measured_by(vectors, found, keys)
            .withColumn("bin", binned(distance()))
            .groupBy(*both, "bin")
            .agg(*_sums())
        )
        found = stage(
            _estimates(_nearest_half(sums, both), both, consistency(HALF)), "quality-step"
        )
    order = W.partitionBy(*keys).orderBy("volume", "start")
    best = found.withColumn("place", F.row_number().over(order)).where("place = 1")
    best = best.drop("place", "start", "volume")
    kept = _measured_by(vectors, best, keys).where(
        distance() <= chi2_quantile(1 - REWEIGHT_TAIL)
    )
    estimates = _estimates(kept.groupBy(*keys).agg(*_sums()), keys, consistency(1 - REWEIGHT_TAIL))
    return stage(estimates.drop("volume"), "quality-fit")


def judge_quality(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    group_columns: tuple[str, ...] = ("lang", "source"),
    steps: int = STEPS,
    reject_tail: float = REJECT_TAIL,
) -> DataFrame:
    """One row per row: ``doc_id``, the statistics, ``base_failed, distance, kept``.

    The estimates of a group come from all its rows that pass the fixed rules; a row is kept
    if it passes them and its squared distance is at most the chi-square quantile. Rows that
    fail have no distance. Null and empty texts have no words and fail. Null languages and
    sources are groups of their own. Repeated rows are measured and judged alike, each
    counts; ids are only carried. A group of one row keeps it. An empty table gives no rows.
    """
    keys = [f"_{c}" for c in group_columns]
    keep = [F.col(id_column).alias("doc_id")]
    keep += [F.col(c).alias(k) for c, k in zip(group_columns, keys)]
    measured = stage(
        text_statistics(docs, text_column, keep).select("*", *vector()), "quality-statistics"
    )
    vectors = measured.where("NOT base_failed").select(*keys, *[f"z{i}" for i in range(D)])
    fitted = fit_groups(vectors, keys, steps)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    fails = measured.where("base_failed").select(
        "doc_id", *names, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")
    )
    limit = chi2_quantile(1 - reject_tail)
    passed = _measured_by(measured.where("NOT base_failed"), fitted, keys).select(
        "doc_id", *names, distance().alias("distance")
    )
    return passed.select("*", (F.col("distance") <= limit).alias("kept")).unionByName(fails)
