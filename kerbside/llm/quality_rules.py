"""Operator 10: quality rules by robust multivariate outliers. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.plans.scratch import Scratch
from kerbside.plans.skew import join_groups

SPACE = r"[\x20\x09-\x0D]"
#: Marks: ASCII ones, general punctuation, and that of East Asian writing.
MARKS = r"[!-/:-@\[-`{-~\u2010-\u2060\u3001-\u303F\uFF01-\uFF0F]"
SPACES = " \t\n\x0b\x0c\r"
#: Units whose estimates are broadcast (about 500 bytes each); beyond it the join shuffles.
BROADCAST_UNITS = 50_000
DIMS = 6
NAMES = tuple(f"f{k}" for k in range(DIMS))
PAIRS = tuple((i, j) for i in range(DIMS) for j in range(i + 1))
#: Share of a unit's documents whose covariance has the least determinant, and the most rounds that are taken to it.
SHARE, ROUNDS = 0.75, 40
#: Ridge of covariances, in squared median absolute deviations: a hundredth of a deviation.
RIDGE = 1e-4
#: Distances are told apart in so many steps an octave.
STEPS = 32
# Fixed values by dimensions 0 to 6, of the chi-squared distribution: consistency factor of the covariance of the
# nearest 75 %, 97.5 % quantile and the factor of what lies within, and the 1 - 1e-6 quantile beyond which a document
# is rejected.
HALF_FACTOR = (1.0, 2.7135, 1.8591, 1.6092, 1.4864, 1.4121, 1.3616)
TRIM = (0.0, 5.0239, 7.3778, 9.3484, 11.1433, 12.8325, 14.4494)
TRIM_FACTOR = (1.0, 1.1748, 1.1045, 1.0785, 1.0645, 1.0555, 1.0493)
CUT = (1.0, 23.928, 27.631, 30.665, 33.377, 35.888, 38.258)
#: Documents that the estimate of the unit above weighs against a unit's own, for the covariance and for the mean; and
#: standard deviations that are expected before there are documents.
PRIOR_N, PRIOR_MEAN_N = 50.0, 1.0
PRIOR_SD = (0.1, 0.4, 0.4, 0.15, 0.3, 0.3)


def statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the transformed vector f0..f5.

    Write the result before it is filtered or aggregated: else Spark puts the splitting of the text into each use.
    """
    d = docs.withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    d = d.withColumn("_w", F.split(F.btrim("_t", F.lit(SPACES)), SPACE + "+"))
    d = d.withColumn("n_words", F.when(F.btrim("_t", F.lit(SPACES)) == "", 0).otherwise(F.size("_w")).cast("long"))
    d = d.withColumn("word_chars", (F.length("_t") - F.regexp_count("_t", F.lit(SPACE))).cast("long"))
    d = d.withColumn("n_symbols", F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"))
    d = d.withColumn("_upper", F.regexp_count("_t", F.lit(r"\p{Lu}")))
    d = d.withColumn("_marks", F.regexp_count("_t", F.lit(MARKS)))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    d = d.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).withColumn("_n_lines", F.size("_l"))
    three = F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    d = d.withColumn("_g", F.when(F.col("n_words") >= 3, three).otherwise(F.array().cast("array<bigint>"))).drop("_w", "_l")
    # Windows found twice or more: neighbours of equal hash in (hash, place) order.
    again = F.size(F.array_distinct("_g")) < F.size("_g")
    d = d.withColumn("_s", F.when(again, F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    equal = lambda x, i: (F.get("_s", i - 1)["h"] == x["h"]) | (F.get("_s", i + 1)["h"] == x["h"])
    places = F.sort_array(F.transform(F.filter("_s", lambda x, i: F.coalesce(equal(x, i), F.lit(False))), lambda x: x["i"]))
    d = d.withColumn("_p", F.when(F.col("_s").isNotNull(), places))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("_p", start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_g", "_s", "_p")
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    chars, words = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    # Rates are drawn to those of prose, as if 100 words of it came before: a short text's rates vary by chance.
    vector = (
        F.log((F.col("word_chars") + 500) / (F.col("n_words") + 100)),
        F.log((F.col("_upper") + 10) / (F.col("word_chars") + 600)),
        F.log((F.col("_marks") + 14) / (F.col("n_words") + 100)),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
    )
    return d.withColumns(dict(zip(NAMES, vector))).drop("_t", "_upper", "_marks", "_n_lines")


def quality_rules(docs: DataFrame, cut: tuple[float, ...] = CUT) -> DataFrame:
    """Keeps a document unless its counts fail the base rules or lie far from those of its language and source.

    docs: columns doc_id, text, lang, source; others are ignored. Returns, for each row, doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, distance (squared; null if base_failed), n_statistics (those
    that the distance is of), kept.

    The vector: logarithms of word length and of the rates of capitals and of marks, roots of the shares of symbols,
    repeated lines and repeated words. Estimates are made of the documents that pass the base rules, for all of them,
    for each language, and for each language and source, by least_determinant(). Each is then taken together with that
    of the unit above it as the posterior of a normal-inverse-Wishart distribution, which weighs like PRIOR_N documents
    (PRIOR_MEAN_N for the mean); above all there is PRIOR_SD. So an estimate exists for units of any size, small ones
    lean on larger ones, and no size switches the test on or off. A statistic without spread (median absolute
    deviation 0: half of the unit's documents share one value) is left out of the unit's vector; units of fewer than
    PRIOR_N documents use the statistics of the unit above. A document is rejected when its squared Mahalanobis
    distance is beyond the quantile of cut for its number of statistics.

    Nulls and empty texts have no words and fail the base rules. Null lang or source: units of their own. Repeated rows
    count each. Empty input: no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    base = docs.select("doc_id", "text", named("lang").alias("_lang"), named("source").alias("_source"))
    d = scratch.write(statistics(base).drop("text"), "statistics")
    key = F.concat_ws("\x1f", "_lang", "_source")
    good = d.where("NOT base_failed")
    fit = good.select(F.explode(F.array(F.lit(""), F.col("_lang"), key)).alias("unit"), *NAMES)
    estimates = least_determinant(fit, scratch)
    units = scratch.write(good.groupBy("_lang", "_source").agg(F.count("*").alias("n")).withColumn("unit", key), "units")
    final = scratch.write(_posterior(estimates, units), "final")
    total = good.count()
    d = d.withColumn("unit", F.when(~F.col("base_failed"), key))
    rest = d.where("unit IS NULL").select(*(c for c in d.columns if not c.startswith(("f", "_"))), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("int").alias("n_statistics"))
    tested = _with_units(d.where("unit IS NOT NULL"), final, total).withColumn("distance", _distance()).withColumn("n_statistics", F.col("live"))
    out = tested.select(*rest.columns).unionByName(rest)
    kept = ~F.col("base_failed") & (F.col("distance") <= _by_dims(cut, F.col("n_statistics")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("distance", 6).alias("distance"), "n_statistics", F.coalesce(kept, F.lit(False)).alias("kept"))


def _by_dims(values: tuple[float, ...], live: Column) -> Column:
    return F.get(F.array(*(F.lit(float(v)) for v in values)), live)


def _with_units(rows: DataFrame, estimates: DataFrame, total: int) -> DataFrame:
    """rows joined by unit to estimates, whose column n has the rows of the unit."""
    if estimates.count() <= BROADCAST_UNITS:
        return rows.join(F.broadcast(estimates.drop("n")), "unit")
    return join_groups(rows, estimates, "unit", "n", total)


def least_determinant(fit: DataFrame, scratch: Scratch) -> DataFrame:
    """Minimum covariance determinant of each unit: unit, n, live0.. (statistics with spread), m0.., c00.. .

    fit: unit, f0... Rows are put on the scale of their unit's medians and median absolute deviations. Three starts:
    mean and covariance of all rows; of their directions from the median (spatial signs); and of the rows within 2.5
    deviations in each statistic. C-steps: distances, the SHARE of the rows with the smallest, their mean and covariance,
    and again. After two steps from each start the one of least determinant goes on until no unit's determinant
    falls any more. The result is scaled for consistency and reweighted by the rows within the 97.5 % quantile.

    Each step is one pass: sums for each unit and step of distance, of which those up to the SHARE are added up, so
    a subset ends with a whole step of distance and may hold a little more than SHARE. A unit of any size is summed up
    in all tasks.
    """
    middle = fit.groupBy("unit").agg(F.count("*").alias("n"), *(F.percentile_approx(f, 0.5, 10000).alias(f"a{k}") for k, f in enumerate(NAMES)))
    middle = scratch.write(middle, "middle")
    total = fit.count()
    off = _with_units(fit, middle, total).groupBy("unit").agg(*(F.percentile_approx(F.abs(F.col(f) - F.col(f"a{k}")), 0.5, 10000).alias(f"d{k}") for k, f in enumerate(NAMES)))
    scale = off.join(middle, "unit").select("unit", "n", *(f"a{k}" for k in range(DIMS)), *((F.col(f"d{k}") * 1.4826).alias(f"s{k}") for k in range(DIMS)))
    scale = scratch.write(scale, "scale")
    z = [F.when(F.col(f"s{k}") > 1e-9, (F.col(f) - F.col(f"a{k}")) / F.col(f"s{k}")).otherwise(F.lit(0.0)).alias(f) for k, f in enumerate(NAMES)]
    rows = scratch.write(_with_units(fit, scale, total).select("unit", *z), "scaled")
    length = F.sqrt(sum((F.col(f) * F.col(f) for f in NAMES), F.lit(0.0)))
    near = F.greatest(*(F.abs(F.col(f)) for f in NAMES)) <= 2.5
    starts = F.array(
        F.struct(F.lit(0).alias("start"), F.lit(1.0).alias("by"), F.lit(True).alias("in")),
        F.struct(F.lit(1).alias("start"), F.when(length > 0, 1 / length).otherwise(F.lit(0.0)).alias("by"), F.lit(True).alias("in")),
        F.struct(F.lit(2).alias("start"), F.lit(1.0).alias("by"), near.alias("in")),
    )
    begun = rows.select("unit", *NAMES, F.explode(starts).alias("_s")).where("_s.in").select("unit", F.col("_s.start").alias("start"), *((F.col(f) * F.col("_s.by")).alias(f) for f in NAMES))
    live = [(F.col(f"s{k}") > 1e-9).alias(f"live{k}") for k in range(DIMS)]
    kinds = scratch.write(scale.select("unit", F.col("n"), *live, sum(((F.col(f"s{k}") > 1e-9).cast("int") for k in range(DIMS)), F.lit(0)).alias("live")), "kinds")

    def factored(sums: DataFrame) -> DataFrame:
        """sums: unit, start, count, sums and sums of products of the rows of a subset -> mean, covariance, its factor and determinant."""
        ridge = lambda i, j: f" + CASE WHEN live{i} THEN {RIDGE}D ELSE 1D END" if i == j else ""
        s = sums.join(kinds, "unit").selectExpr("unit", "start", "n", "live", *(f"live{k}" for k in range(DIMS)), *(f"t{k} / c AS m{k}" for k in range(DIMS)), *(f"q{i}{j} / c - t{i} / c * t{j} / c{ridge(i, j)} AS c{i}{j}" for i, j in PAIRS))
        return _factor(s).withColumn("det", F.expr(" + ".join(f"2 * ln(l{k}{k})" for k in range(DIMS))))

    moments = [F.count("*").alias("c"), *(F.expr(f"sum(f{k}) AS t{k}") for k in range(DIMS)), *(F.expr(f"sum(f{i} * f{j}) AS q{i}{j}") for i, j in PAIRS)]

    def step(estimate: DataFrame) -> DataFrame:
        x = _with_units(rows, estimate.select("unit", "start", "n", "live", *(f"live{k}" for k in range(DIMS)), *(f"m{k}" for k in range(DIMS)), *(f"w{i}{j}" for i, j in PAIRS)), total)
        place = F.floor(STEPS * F.log2(F.greatest(_distance(), F.lit(2.0**-4)))).cast("int")
        by = x.withColumn("place", place).groupBy("unit", "start", "place").agg(*moments)
        own = Window.partitionBy("unit", "start")
        upto = F.sum("c").over(own.orderBy("place")) - F.col("c")
        by = by.withColumn("before", upto).withColumn("all", F.sum("c").over(own)).where(F.col("before") < F.ceil(F.col("all") * SHARE))
        sums = by.groupBy("unit", "start").agg(*(F.expr(f"sum({c}) AS {c}") for c in ("c", *(f"t{k}" for k in range(DIMS)), *(f"q{i}{j}" for i, j in PAIRS))))
        return factored(sums)

    estimate = scratch.write(factored(begun.groupBy("unit", "start").agg(*moments)), "start")
    for _ in range(2):
        estimate = scratch.write(step(estimate), "step")
    columns = estimate.columns
    best = F.min_by(F.struct(*columns), F.struct("det", "start"))
    estimate = scratch.write(estimate.groupBy("unit").agg(best.alias("b")).select("b.*"), "best")
    done: list[DataFrame] = []
    for _ in range(ROUNDS):
        new = step(estimate).select(*(F.col(c).alias(f"new_{c}") for c in columns))
        pair = estimate.join(new, estimate.unit == new.new_unit)
        falls = F.col("new_det") < F.col("det") - 1e-3
        pair = scratch.write(pair.withColumn("falls", falls), "step")
        done.append(pair.where("NOT falls").select(*columns))
        estimate = pair.where("falls").select(*(F.col(f"new_{c}").alias(c) for c in columns))
        if not estimate.limit(1).count():
            break
    else:
        done.append(estimate.select(*columns))
    raw = done[0]
    for t in done[1:]:
        raw = raw.unionByName(t)
    raw = scratch.write(raw, "raw")
    x = _with_units(rows, raw.drop("det"), total)
    inside = _distance() / _by_dims(HALF_FACTOR, F.col("live")) <= _by_dims(TRIM, F.col("live")) + 1e-9
    out = factored(x.where(inside).groupBy("unit", "start").agg(*moments)).join(scale.drop("n"), "unit")
    factor = _by_dims(TRIM_FACTOR, F.col("live"))
    mean = [f"a{k} + CASE WHEN live{k} THEN s{k} * m{k} ELSE 0D END AS m{k}" for k in range(DIMS)]
    cov = [f"CASE WHEN live{i} AND live{j} THEN c{i}{j} * s{i} * s{j} * factor ELSE 0D END AS c{i}{j}" for i, j in PAIRS]
    out = scratch.write(out.withColumn("factor", factor).selectExpr("unit", "n", *(f"live{k}" for k in range(DIMS)), *mean, *cov), "estimates")
    scratch.drop(middle, scale, rows, kinds, raw)
    return out


def _posterior(estimates: DataFrame, units: DataFrame) -> DataFrame:
    """unit, n, live, live0.., m0.., l00.. of each language and source: its estimate upon its language's upon that of all documents upon PRIOR_SD."""
    columns = ("n", *(f"live{k}" for k in range(DIMS)), *(f"m{k}" for k in range(DIMS)), *(f"c{i}{j}" for i, j in PAIRS))
    e = estimates.select("unit", F.struct(*columns).alias("e"))
    at = lambda name: e.select(F.col("unit").alias(f"{name}_unit"), F.col("e").alias(name))
    rows = units.select("unit", "_lang", "n").join(at("own"), F.col("unit") == F.col("own_unit")).join(at("by_lang"), F.col("_lang") == F.col("by_lang_unit"))
    top = e.where("unit = ''").first()  # one row; none if no document passes the base rules
    rows = rows.withColumn("every", F.lit(None).cast(e.schema["e"].dataType) if top is None else F.struct(*(F.lit(top.e[c]).alias(c) for c in columns)))
    rows = rows.selectExpr("*", *(f"every.m{k} AS pm{k}" for k in range(DIMS)), *(f"true AS plive{k}" for k in range(DIMS)), *(f"{PRIOR_SD[i] ** 2 if i == j else 0}D AS p{i}{j}" for i, j in PAIRS))
    names = ("unit", "n", "every", "by_lang", "own")
    for o in ("every", "by_lang", "own"):
        live = [f"CASE WHEN {o}.n >= {PRIOR_N} THEN {o}.live{k} ELSE plive{k} END AS plive{k}" for k in range(DIMS)]
        mean = [f"CASE WHEN plive{k} THEN ({o}.n * {o}.m{k} + {PRIOR_MEAN_N}D * pm{k}) / ({o}.n + {PRIOR_MEAN_N}D) ELSE {o}.m{k} END AS pm{k}" for k in range(DIMS)]
        between = [f"({o}.m{i} - pm{i}) * ({o}.m{j} - pm{j}) * {PRIOR_MEAN_N}D * {o}.n / ({o}.n + {PRIOR_MEAN_N}D)" for i, j in PAIRS]
        cov = [f"CASE WHEN plive{i} AND plive{j} THEN ({o}.n * {o}.c{i}{j} + {PRIOR_N}D * p{i}{j} + {b}) / ({o}.n + {PRIOR_N}D) ELSE {o}.c{i}{j} END AS p{i}{j}" for (i, j), b in zip(PAIRS, between)]
        rows = rows.select(*names, *(F.expr(x) for x in (*live, *mean, *cov)))
    rows = rows.selectExpr("unit", "n", *(f"plive{k} AS live{k}" for k in range(DIMS)), " + ".join(f"int(plive{k})" for k in range(DIMS)) + " AS live", *(f"pm{k} AS m{k}" for k in range(DIMS)), *(f"CASE WHEN plive{i} AND plive{j} THEN p{i}{j} ELSE {int(i == j)}D END AS c{i}{j}" for i, j in PAIRS))
    return _factor(rows)


def _factor(s: DataFrame) -> DataFrame:
    """Adds l00.., the Cholesky factor of the covariance c00.., and w00.., the inverse of that."""
    new = []
    for i, j in PAIRS:
        x = " - ".join([f"c{i}{j}", *(f"l{i}{k} * l{j}{k}" for k in range(j))])
        new.append(f"sqrt(greatest({x}, 1e-12D)) AS l{i}{j}" if i == j else f"({x}) / l{j}{j} AS l{i}{j}")
    for i, j in PAIRS:
        x = " - ".join(["1D" if i == j else "0D", *(f"l{i}{k} * w{k}{j}" for k in range(j, i))])
        new.append(f"({x}) / l{i}{i} AS w{i}{j}")
    return s.selectExpr("*", *new)


def _distance() -> Column:
    """Squared Mahalanobis distance of f from m by w, the inverse factor; statistics that don't count add nothing."""
    z = [" + ".join(f"w{i}{k} * CASE WHEN live{k} THEN f{k} - m{k} ELSE 0D END" for k in range(i + 1)) for i in range(DIMS)]
    return F.expr(" + ".join(f"power({x}, 2)" for x in z))
