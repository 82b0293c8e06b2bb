"""Quality rules: text statistics and robust multivariate outliers.

Per group of language and source, centre and covariance of transformed statistics are estimated by the
minimum covariance determinant: concentration steps refit them on the share of rows with the smallest
Mahalanobis distances. There are two starts, both about the coordinate-wise medians: deviations of the
statistics one by one, and the covariance of the rows' spatial signs. Of each group the start whose
covariance has the smaller determinant goes on. Rows far from their group's centre are rejected. All of
it is DataFrame work; per-group quantiles come from counts of bins, so no group is gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from boxoffice.functions.scale import materialize

GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8
#: The transformed statistics, with the standard deviation each has at least. Within a group of good
#: texts a statistic may hardly vary at all; a smaller difference than this says nothing.
STATS = {
    "x_word_length": 0.15,
    "x_symbols": 0.04,
    "x_dup_lines": 0.12,
    "x_repeats": 0.1,
    "x_capitals": 0.08,
    "x_signs": 0.08,
    "x_stutter": 0.08,
}
NAMES = tuple(STATS)
#: Concentration steps of both starts, and further ones of the better.
TRIAL_STEPS, LAST_STEPS = 2, 2


def statistics(rows: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the transformed statistics
    to rows with ``text`` (not null), which is dropped."""
    words = F.filter(F.split("text", GAP), lambda w: w != "")
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD))
    cut = rows.select(
        "*",
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_capitals"),
        F.regexp_count("text", F.lit(r"[!-/:-@\[-`{-~]")).alias("n_signs"),
        lines.alias("lines"),
        F.when(F.length("text") >= 2 * WINDOW - 1, F.transform(words, lambda w: F.xxhash64(w))).alias("hashes"),
    ).drop("text")
    # A window's fingerprint combines those of its words.
    last = F.size("hashes") - WINDOW
    window = lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)])
    cut = cut.select(
        *[c for c in cut.columns if c not in ("lines", "hashes")],
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size(F.filter("hashes", lambda h, i: h == F.get("hashes", i - 1))), F.lit(0)).alias("n_stutters"),
        F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), window)).alias("windows"),
    )
    # Only texts with a repeated window are looked at further: places of windows in order of their
    # fingerprints, those with an equal neighbour, and how far each reaches before the next begins.
    repeated = F.size("windows") > F.size(F.array_distinct("windows"))
    pairs = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    cut = cut.withColumn("pairs", F.when(repeated, pairs)).drop("windows")
    beside = lambda p, k: F.coalesce(F.get("pairs", k)["h"] == p["h"], F.lit(False))
    cut = cut.withColumn("pairs", F.filter("pairs", lambda p, k: beside(p, k - 1) | beside(p, k + 1)))
    cut = cut.withColumn("places", F.array_sort(F.transform("pairs", lambda p: p["i"]))).drop("pairs")
    reach = F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda total, x: total + x)
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    counted = cut.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("places")
    return counted.select(
        *[c for c in counted.columns if c not in ("n_lines", "n_capitals", "n_signs", "n_stutters")],
        F.log1p(share("word_chars", "n_words")).alias("x_word_length"),
        F.sqrt(share("n_symbols", "word_chars")).alias("x_symbols"),
        share("n_dup_lines", "n_lines").alias("x_dup_lines"),
        share("n_repeat_words", "n_words").alias("x_repeats"),
        F.sqrt(share("n_capitals", "word_chars")).alias("x_capitals"),
        F.sqrt(share("n_signs", "word_chars")).alias("x_signs"),
        share("n_stutters", "n_words").alias("x_stutter"),
    )


def _chi2_below(x: float, degrees: int) -> float:
    """The chi-square distribution, from one or two degrees up by two at a time."""
    known = 2 - degrees % 2
    below = math.erf(math.sqrt(x / 2)) if known == 1 else 1 - math.exp(-x / 2)
    for k in range(known, degrees, 2):
        below -= (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
    return below


def chi2_quantile(share: float, degrees: int) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2_below(middle, degrees) < share else (low, middle)
    return high


def group_quantile(rows: DataFrame, keys: list[str], bin_: Column, share: float, name: str) -> DataFrame:
    """Per key the lowest bin up to which at least ``share`` of its rows lie. Counts of bins are taken
    before the shuffle; bins are few by what they are."""
    bins = rows.select(*keys, bin_.cast("long").alias("bin")).groupBy(*keys, "bin").count()
    upto = F.sum("count").over(Window.partitionBy(*keys).orderBy("bin"))
    total = F.sum("count").over(Window.partitionBy(*keys))
    reached = bins.withColumn("upto", upto).withColumn("total", total).filter(F.col("upto") >= F.col("total") * share)
    return reached.groupBy(*keys).agg(F.min("bin").alias(name))


def _medians(rows: DataFrame, values: dict[str, Column], step: float) -> DataFrame:
    """Per group g the median of each value, to a step's accuracy."""
    pairs = F.array(*[F.struct(F.lit(n).alias("dim"), F.floor(v / step).alias("bin")) for n, v in values.items()])
    long = rows.select("g", F.explode(pairs).alias("p")).select("g", "p.dim", "p.bin")
    found = group_quantile(long, ["g", "dim"], F.col("bin"), 0.5, "bin")
    return found.groupBy("g").agg(*[((F.max(F.when(F.col("dim") == n, F.col("bin"))) + 0.5) * step).alias(n) for n in values])


def factors(fits: DataFrame, covariance: dict[tuple[int, int], Column]) -> DataFrame:
    """Add the Cholesky factors of the covariance, _lij, and the logarithm of its determinant to rows of
    fits, one for each group and start."""
    cell = lambda i, j: F.col(f"_l{i}{j}")
    for j in range(len(NAMES)):
        for i in range(j, len(NAMES)):
            own = covariance[j, i]
            for k in range(j):
                own = own - cell(i, k) * cell(j, k)
            fits = fits.withColumn(f"_l{i}{j}", F.sqrt(F.greatest(own, F.lit(1e-12))) if i == j else own / cell(j, j))
    return fits.withColumn("log_det", sum((2 * F.log(cell(j, j)) for j in range(1, len(NAMES))), 2 * F.log(cell(0, 0))))


def distances(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """Each row with each fit of its group: start and d2, the squared Mahalanobis distance."""
    near, total = rows.join(fits, F.col("g") == F.col("own_g")), F.lit(0.0)
    for j, name in enumerate(NAMES):
        own = F.col(name) - F.col(f"m_{name}")
        for k in range(j):
            own = own - F.col(f"_l{j}{k}") * F.col(f"_y{k}")
        near = near.withColumn(f"_y{j}", own / F.col(f"_l{j}{j}"))
        total = total + F.col(f"_y{j}") * F.col(f"_y{j}")
    return near.select(*rows.columns, "start", total.alias("d2"))


def _log_bin(d2: str) -> Column:
    """64 bins for each factor of two, from 2**-40 to 2**60."""
    return F.floor(64 * F.log2(F.greatest(F.lit(2.0**-40), F.least(F.lit(2.0**60), F.col(d2)))))


def _starts(rows: DataFrame) -> DataFrame:
    """Two fits of each group g about its medians: median absolute deviations, and the covariance of
    spatial signs in units of these."""
    p = len(NAMES)
    floors = [STATS[n] for n in NAMES]
    centre = materialize(_medians(rows, {n: F.col(n) for n in NAMES}, 1 / 256), "centre").select(F.col("g").alias("own_g"), *[F.col(n).alias(f"m_{n}") for n in NAMES])
    near = rows.join(centre, F.col("g") == F.col("own_g"))
    spread = _medians(near, {n: F.abs(F.col(n) - F.col(f"m_{n}")) for n in NAMES}, 1 / 256)
    spread = spread.select(F.col("g").alias("spread_g"), *[F.greatest(1.4826 * F.col(n), F.lit(STATS[n])).alias(f"s_{n}") for n in NAMES])
    scales = materialize(centre.join(spread, F.col("own_g") == F.col("spread_g")).drop("spread_g"), "scales")
    alone = factors(scales, {(i, j): F.col(f"s_{NAMES[i]}") ** 2 if i == j else F.lit(0.0) for i in range(p) for j in range(i, p)})
    near = rows.join(scales, F.col("g") == F.col("own_g"))
    near = near.select("own_g", *[((F.col(n) - F.col(f"m_{n}")) / F.col(f"s_{n}")).alias(f"z{i}") for i, n in enumerate(NAMES)])
    length = sum((F.col(f"z{i}") ** 2 for i in range(1, p)), F.col("z0") ** 2)
    signs = near.withColumn("length", F.greatest(length, F.lit(1e-12)))
    moments = [F.avg(F.col(f"z{i}") * F.col(f"z{j}") / F.col("length")).alias(f"c{i}{j}") for i in range(p) for j in range(i, p)]
    signs = materialize(signs.groupBy(F.col("own_g").alias("sign_g")).agg(*moments), "signs")
    joint = {(i, j): p * F.col(f"c{i}{j}") * F.col(f"s_{NAMES[i]}") * F.col(f"s_{NAMES[j]}") + (floors[i] ** 2 if i == j else 0.0) for i in range(p) for j in range(i, p)}
    together = factors(scales.join(signs, F.col("own_g") == F.col("sign_g")), joint)
    shown = ["own_g", *[f"m_{n}" for n in NAMES], *[f"_l{i}{j}" for j in range(p) for i in range(j, p)], "log_det"]
    fits = alone.select(F.lit(0).alias("start"), *shown).unionByName(together.select(F.lit(1).alias("start"), *shown))
    return materialize(fits, "starts")


def _concentrated(rows: DataFrame, fits: DataFrame, share: float) -> DataFrame:
    """Fits on the share of each group's rows that is nearest by ``fits``. Bounds are written, so that
    their size is known and rows need not be shuffled by group to meet them."""
    p = len(NAMES)
    grow = share / _chi2_below(chi2_quantile(share, p), p + 2)
    apart = distances(rows, fits)
    bound = group_quantile(apart, ["g", "start"], _log_bin("d2"), share, "bound")
    bound = materialize(bound, "bound").select(F.col("g").alias("bound_g"), F.col("start").alias("bound_start"), "bound")
    inner = apart.join(bound, (F.col("g") == F.col("bound_g")) & (F.col("start") == F.col("bound_start"))).filter(_log_bin("d2") <= F.col("bound"))
    means = [F.avg(n).alias(f"m_{n}") for n in NAMES]
    moments = [F.covar_pop(NAMES[i], NAMES[j]).alias(f"c{i}{j}") for i in range(p) for j in range(i, p)]
    fitted = inner.groupBy(F.col("g").alias("own_g"), "start").agg(*means, *moments)
    covariance = {(i, j): grow * F.col(f"c{i}{j}") + (STATS[NAMES[i]] ** 2 if i == j else 0.0) for i in range(p) for j in range(i, p)}
    fitted = factors(materialize(fitted, "moments"), covariance)
    return materialize(fitted.drop(*[f"c{i}{j}" for i in range(p) for j in range(i, p)]), "fitted")


def robust_distances(rows: DataFrame, share: float = 0.75) -> DataFrame:
    """Add d2, the squared robust distance, to rows with ``fit_group`` (not null) and the statistics.
    ``rows`` must be cheap to read again. Groups' parameters are tables and are joined by their size."""
    rows = rows.withColumnRenamed("fit_group", "g")
    fits = _starts(rows)
    for _ in range(TRIAL_STEPS):
        fits = _concentrated(rows, fits, share)
    best = fits.groupBy(F.col("own_g").alias("best_g")).agg(F.min(F.struct("log_det", "start")).alias("best"))
    fits = materialize(fits.join(best, (F.col("own_g") == F.col("best_g")) & (F.col("start") == F.col("best.start")), "left_semi"), "fitted")
    for _ in range(LAST_STEPS):
        fits = _concentrated(rows, fits, share)
    return distances(rows, fits).drop("start").withColumnRenamed("g", "fit_group")


def fit_groups(rows: DataFrame, least: int) -> DataFrame:
    """Add fit_group: language and source; a group of fewer than ``least`` rows is taken together with
    the other small ones of its language, and these, if still few, over all languages."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    named = rows.withColumn("own_lang", name("lang")).withColumn("own_source", name("source"))
    sizes = named.groupBy("own_lang", "own_source").count()
    small = F.sum(F.when(F.col("count") < least, F.col("count")).otherwise(0)).over(Window.partitionBy("own_lang"))
    both = F.concat(F.length("own_lang").cast("string"), F.lit(":"), "own_lang", "own_source")
    group = F.when(F.col("count") >= least, both).when(small >= least, F.concat(F.lit("lang"), "own_lang")).otherwise("all")
    groups = sizes.select(F.col("own_lang").alias("l"), F.col("own_source").alias("s"), group.alias("fit_group"))
    return named.join(groups, (F.col("own_lang") == F.col("l")) & (F.col("own_source") == F.col("s"))).drop("own_lang", "own_source", "l", "s")


def quality_rules(docs: DataFrame, reject: float = 0.99999, least: int = 100, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row: ``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept and distance (squared, null for rows that fail the base rules).

    Estimates are fitted on the rows that pass the base rules. A row is kept if it passes them and its
    distance is at most the chi-square quantile ``reject``. Null and empty texts have no words and fail.
    Null languages and sources are groups of their own. Repeated rows count each; ties at the edge of
    the fitted share all belong to it. Whole texts are read.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = materialize(statistics(rows).withColumn("base_failed", failed), "statistics")
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passed = materialize(fit_groups(stats.filter(~F.col("base_failed")), least), "passed")
    judged = robust_distances(passed).withColumn("kept", F.col("d2") <= chi2_quantile(reject, len(NAMES)))
    columns = [F.col("id").alias(id_col), *own]
    out = judged.select(*columns, "kept", F.col("d2").alias("distance"))
    rest = stats.filter("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return out.unionByName(rest)
