"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Each document becomes a vector of transformed statistics. Each language and source has a minimum-covariance-determinant
estimate (falling back to the language, then to all documents, where a group is small): of the COVERED share of rows
that lie close together, mean and covariance. Three starts (medians with absolute deviations, all rows, the rows near
the medians) each take concentration steps: keep the COVERED share of rows that lie nearest by Mahalanobis distance,
estimate from them, and repeat. The start whose covariance has the least determinant goes on until no group's
determinant falls any more. A document is rejected when its squared distance from its group's estimate exceeds the
quantile of the chi-squared distribution that one normal document in 10,000 exceeds.

One step is one aggregation of slim rows by (group, distance bin) with map-side sums, so neither a hot source nor the
number of rows matters: the rows of a group never meet. Statistics are whole numbers (in 1 / GRID), so that sums, and
with them the verdicts, do not depend on the order of rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import SPACE, WORD, as_text, count_of, documents, free, mark, materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of a group's rows that the estimate rests on.
COVERED = 0.75
#: Concentration steps of every start, and at most so many more of the best.
TRIAL_STEPS, STEPS = 2, 4
#: Groups with fewer rows use their language's estimate, or that of all documents.
MIN_GROUP = 200
GRID = 1024
BINS = 96
#: The 0.9999 quantile of the chi-squared distribution with 6 degrees of freedom, one for each statistic.
CUTOFF = 27.856
#: What makes the covariance of the nearest COVERED share consistent for normal rows: COVERED over the probability that
#: chi-squared with 8 degrees of freedom stays below the COVERED quantile of that with 6 (7.841): 0.75 / 0.5508.
CONSISTENT = 1.3617

#: Transformed statistics, each with a spread whose square is added to its variance, as a regularised estimate does: most
#: documents have no symbols or repeats at all, so that the plain determinant is zero. Each statistic can pass the
#: cut-off alone within its range: an angle reaches 1.571, and repeats 0.785 before the base rule rejects.
VECTOR = {
    "mean_word": 0.12,
    "symbols": 0.05,
    "repeats": 0.125,
    "dup_lines": 0.25,
    "capitals": 0.05,
    "bangs": 0.05,
}
LEVELS = (("lang", "source"), ("lang",), ())


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of the contract and two more, under names that start with q_. Null texts have no words."""
    body = as_text(text)
    words = F.filter(F.split(body, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    out = docs.withColumn("q_words", words).withColumn("q_lines", lines)
    n = F.size("q_words")
    # A window's hash and its place in one long: sorted, equal windows are neighbours.
    bits = F.greatest(F.ceil(F.log2(F.greatest(n, F.lit(2)))), F.lit(1)).cast("int")
    out = out.withColumn("q_bits", bits).withColumn("q_n", n)
    out = out.withColumn("q_windows", F.expr(
        "sort_array(if(q_n < 3, array(), transform(sequence(0, greatest(q_n, 3) - 3),"
        " i -> (shiftleft(xxhash64(get(q_words, i), get(q_words, i + 1), get(q_words, i + 2)), q_bits) | i))))"
    ))
    # Equal hashes are checked by the words: hashes lose as many bits as places need.
    word = "get(q_words, cast({0} & (shiftleft(1L, q_bits) - 1) as int) + {1})"
    equal = " and ".join(f"{word.format('x', k)} = {word.format('get(q_windows, i {0} 1)', k)}" for k in range(3))
    same = f"shiftright(x, q_bits) = shiftright(get(q_windows, i {{0}} 1), q_bits) and {equal}"
    out = out.withColumn("q_again", F.expr(
        f"sort_array(transform(filter(q_windows, (x, i) -> coalesce({same.format('-')}, false) or coalesce({same.format('+')}, false)),"
        " x -> x & (shiftleft(1L, q_bits) - 1)))"
    ))
    return out.withColumns({
        "q_n_words": F.col("q_n").cast("long"),
        "q_word_chars": F.aggregate("q_words", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)),
        "q_n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
        "q_n_lines": F.size("q_lines").cast("long"),
        "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        # Windows overlap: each covers three words, or as many as lie before the next.
        "q_n_repeat_words": F.expr("aggregate(q_again, 0L, (a, x) -> a + 3) - aggregate(zip_with(slice(q_again, 2, greatest(size(q_again) - 1, 0)),"
                                   " slice(q_again, 1, greatest(size(q_again) - 1, 0)), (b, a) -> greatest(3 - (b - a), 0)), 0L, (a, x) -> a + x)"),
        "q_n_capitals": F.regexp_count(body, F.lit("\\p{Lu}")).cast("long"),
        "q_n_bangs": count_of(body, "!").cast("long"),
    }).drop("q_words", "q_lines", "q_bits", "q_n", "q_windows", "q_again")


def base_failed() -> Column:
    return (F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("q_n_words"))


def vector() -> dict[str, Column]:
    """The transformed statistics as whole numbers of 1 / GRID."""
    share = lambda a, b: F.least(F.col(a) / F.greatest(F.col(b), F.lit(1)), F.lit(1.0))
    angle = lambda x: F.asin(F.sqrt(x))  # noqa: E731  a share's variance no longer depends on the share
    out = {
        "mean_word": F.log(F.greatest(F.col("q_word_chars"), F.lit(1)) / F.greatest(F.col("q_n_words"), F.lit(1))),
        "symbols": angle(share("q_n_symbols", "q_word_chars")),
        "repeats": angle(share("q_n_repeat_words", "q_n_words")),
        "dup_lines": angle(share("q_n_dup_lines", "q_n_lines")),
        "capitals": angle(share("q_n_capitals", "q_word_chars")),
        "bangs": angle(share("q_n_bangs", "q_word_chars")),
    }
    return {f"q_x_{k}": F.round(c * GRID).cast("long") for k, c in out.items()}


def _names() -> list[str]:
    return [f"q_x_{k}" for k in VECTOR]


def _distance(mean: str = "m_", low: str = "l_") -> Column:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor."""
    names = list(VECTOR)
    z: list[Column] = []
    for i, a in enumerate(names):
        v = F.col(f"q_x_{a}") / GRID - F.col(f"{mean}{a}")
        for j in range(i):
            v = v - F.col(f"{low}{i}_{j}") * z[j]
        z.append(v / F.col(f"{low}{i}_{i}"))
    out = z[0] * z[0]
    for x in z[1:]:
        out = out + x * x
    return out


def _factor(model: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_i_j of the covariance c_i_j, column by column."""
    d = len(VECTOR)
    for j in range(d):
        own = F.col(f"c_{j}_{j}")
        for k in range(j):
            own = own - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}")
        floor = F.lit(list(VECTOR.values())[j] ** 2 / 4)
        model = model.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(own, floor)))
        cols = {}
        for i in range(j + 1, d):
            v = F.col(f"c_{i}_{j}")
            for k in range(j):
                v = v - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            cols[f"l_{i}_{j}"] = v / F.col(f"l_{j}_{j}")
        if cols:
            model = model.withColumns(cols)
    return model


def _by_levels(slim: DataFrame) -> DataFrame:
    """Each row once for each level that it counts for."""
    at = [F.struct(F.lit(n).alias("g_level"), *[(F.col(f"q_{c}") if c in level else F.lit(None).cast("string")).alias(f"g_{c}") for c in ("lang", "source")]) for n, level in enumerate(LEVELS)]
    return slim.select(*_names(), F.explode(F.array(*at)).alias("g")).select(*_names(), "g.*")


def _same_group(a: DataFrame, b: DataFrame) -> Column:
    return (a["g_level"] == b["g_level"]) & a["g_lang"].eqNullSafe(b["g_lang"]) & a["g_source"].eqNullSafe(b["g_source"])


GROUP = ["g_level", "g_lang", "g_source"]


MODEL = [f"m_{k}" for k in VECTOR] + [f"l_{i}_{j}" for i in range(len(VECTOR)) for j in range(i + 1)]


def _sums() -> dict[str, Column]:
    names = _names()
    return {f"s_{i}": F.sum(a) for i, a in enumerate(names)} | {f"p_{i}_{j}": F.sum(F.col(a) * F.col(names[j])) for i, a in enumerate(names) for j in range(i + 1)}


def _estimate(total: DataFrame, by: list[str], factor: float) -> DataFrame:
    """Means and the factored covariance, from sums of the rows that count."""
    model = total.withColumns({f"m_{k}": F.col(f"s_{i}") / F.col("n") / GRID for i, k in enumerate(VECTOR)})
    model = model.withColumns({
        f"c_{i}_{j}": (F.col(f"p_{i}_{j}") / F.col("n") / GRID**2 - F.col(f"m_{a}") * F.col(f"m_{b}")) * factor + (F.lit(VECTOR[a] ** 2) if i == j else F.lit(0.0))
        for i, a in enumerate(VECTOR) for j, b in enumerate(VECTOR) if j <= i
    })
    return _factor(model).select(*by, "g_rows", *MODEL)


def _log_determinant() -> Column:
    """Of the covariance, by its factor's diagonal."""
    out = F.lit(0.0)
    for i in range(len(VECTOR)):
        out = out + 2 * F.log(F.col(f"l_{i}_{i}"))
    return out


def _starts(rows: DataFrame) -> DataFrame:
    """Three first estimates of each group, told apart by g_start. Exact: the grid bounds distinct values.

    0: medians, and 1.4826 times the median absolute deviations; 1: all rows; 2: the rows that lie within three of those
    deviations of the medians in every statistic (a group without such rows does without).
    """
    medians = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("g_rows"), *[F.percentile(f"q_x_{k}", F.lit(0.5)).alias(f"m_{k}") for k in VECTOR])
    medians = materialize(medians, "medians")
    off = rows.join(medians, _same_group(rows, medians)).select(*[rows[g] for g in GROUP], medians["g_rows"], *[medians[f"m_{k}"] for k in VECTOR], *[F.abs(rows[f"q_x_{k}"] - F.col(f"m_{k}")).alias(f"a_{k}") for k in VECTOR])
    spread = off.groupBy(*GROUP).agg(F.first("g_rows").alias("g_rows"), *[(F.first(f"m_{k}") / GRID).alias(f"m_{k}") for k in VECTOR], *[F.percentile(f"a_{k}", F.lit(0.5)).alias(f"a_{k}") for k in VECTOR])
    spread = spread.withColumns({f"c_{i}_{j}": (F.pow(F.col(f"a_{a}") * 1.4826 / GRID, 2) + F.lit(VECTOR[a] ** 2) if i == j else F.lit(0.0)) for i, a in enumerate(VECTOR) for j in range(i + 1)})
    first = materialize(_factor(spread).select(*GROUP, "g_rows", *MODEL), "mcd-medians")
    near = F.lit(True)
    for i, k in enumerate(VECTOR):
        near = near & (F.abs(F.col(f"q_x_{k}") / GRID - F.col(f"m_{k}")) <= 3 * F.col(f"l_{i}_{i}"))
    joined = rows.join(first, _same_group(rows, first)).select(*[rows[g] for g in GROUP], first["g_rows"], *[rows[n] for n in _names()], F.when(near, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("of"))
    total = joined.withColumn("g_start", F.explode("of")).groupBy(*GROUP, "g_start").agg(F.first("g_rows").alias("g_rows"), F.count(F.lit(1)).alias("n"), *[c.cast("double").alias(k) for k, c in _sums().items()])
    return materialize(first.withColumn("g_start", F.lit(0)).unionByName(_estimate(total, [*GROUP, "g_start"], 1.0)), "mcd-starts")


def _step(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One concentration step of every start: the nearest COVERED share of each group gives its new mean and covariance."""
    by = [*GROUP, "g_start"]
    near = rows.join(model, _same_group(rows, model)).select(*[rows[g] for g in GROUP], model["g_start"], model["g_rows"], *[rows[n] for n in _names()], F.least(F.greatest(F.floor(8 * F.log2(_distance() + 1e-3)) + 40, F.lit(0)), F.lit(BINS - 1)).cast("int").alias("bin"))
    sums = _sums()
    binned = near.groupBy(*by, "bin").agg(F.first("g_rows").alias("g_rows"), F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in sums.items()])
    nearer = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    used = binned.withColumn("before", F.coalesce(F.sum("n").over(nearer), F.lit(0))).filter(F.col("before") < F.ceil(F.col("g_rows") * COVERED))
    total = used.groupBy(*by).agg(F.first("g_rows").alias("g_rows"), F.sum("n").alias("n"), *[F.sum(k).cast("double").alias(k) for k in sums])
    return _estimate(total, by, CONSISTENT)


def _least(models: DataFrame) -> DataFrame:
    """Of each group's estimates, that of least determinant."""
    whole = F.struct("g_start", "g_rows", *MODEL)
    return models.groupBy(*GROUP).agg(F.min_by(whole, F.struct(_log_determinant(), F.col("g_start"))).alias("m")).select(*GROUP, "m.*")


def fit(slim: DataFrame) -> DataFrame:
    """The estimate of every (lang, source): its own, or its language's, or that of all rows.

    slim: q_lang, q_source and the vector, cheap to read again. One row per (lang, source) that occurs.
    """
    rows = _by_levels(slim)
    model = _starts(rows)
    for _ in range(TRIAL_STEPS):
        model = materialize(_step(rows, model), "mcd")
    model = materialize(_least(model), "mcd")
    for _ in range(STEPS):
        after = materialize(_least(_step(rows, model).unionByName(model)), "mcd")
        fell = after.select(F.sum(_log_determinant())).first()[0] or 0.0
        known = model.select(F.sum(_log_determinant())).first()[0] or 0.0
        model = after
        if fell > known - 1e-9:
            break
    own = slim.select("q_lang", "q_source").distinct()
    rank = F.struct((F.col("g_rows") >= MIN_GROUP).alias("a"), (-F.col("g_level")).alias("b"))
    # Three equi joins, one per level, instead of one condition that matches no key.
    out = None
    for n, level in enumerate(LEVELS):
        of = model.filter(F.col("g_level") == n)
        on = F.lit(True)
        for c in level:
            on = on & F.col(f"g_{c}").eqNullSafe(F.col(f"q_{c}"))
        hit = own.join(of if level else F.broadcast(of.limit(1)), on)
        out = hit if out is None else out.unionByName(hit)
    best = out.groupBy("q_lang", "q_source").agg(F.max_by(F.struct(*MODEL), rank).alias("m"))
    return materialize(best.select("q_lang", "q_source", "m.*"), "mcd-by-source")


def slim_rows(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", **more: Column) -> DataFrame:
    kept = docs.select(F.col(text).alias("q_text"), F.col(lang).cast("string").alias("q_lang"), F.col(source).cast("string").alias("q_source"), *[c.alias(k) for k, c in more.items()])
    return with_counts(kept, "q_text").withColumns(vector()).drop("q_text")


def _judged(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Adds q_distance and q_kept; all rows of docs stay."""
    of = model.withColumnRenamed("q_lang", "g_lang").withColumnRenamed("q_source", "g_source")
    out = rows.join(of, F.col("q_lang").eqNullSafe(F.col("g_lang")) & F.col("q_source").eqNullSafe(F.col("g_source")), "left")
    # One condition on both sides of the join: a filter on the counts alone would be pushed below it, and repeat them.
    kept = F.when(base_failed(), F.lit(False)).otherwise(F.coalesce("q_distance", F.lit(0.0)) <= CUTOFF)
    return out.withColumn("q_distance", _distance()).withColumn("q_kept", kept).drop(*[c for c in of.columns])


def quality_verdicts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    A null or empty text has no words, which fails the base rules; a null lang or source is a group of its own.
    Repeated rows get equal verdicts; no rows give no rows; further columns of docs are not read.
    """
    slim = materialize(slim_rows(docs, text, lang, source, q_doc_id=F.col(doc_id)), "quality-counts")
    model = fit(slim.filter(F.col("q_n_words") >= MIN_WORDS))
    out = _judged(slim, model).withColumn("q_base", base_failed())
    return out.select(F.col("q_doc_id").alias("doc_id"), *[F.col(f"q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], F.col("q_base").alias("base_failed"), F.col("q_kept").alias("kept"), F.col("q_distance").alias("distance"))


def drop_outliers(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. The counts are computed again rather than joined:
    that costs CPU, but moves no text."""
    since = mark()
    slim = materialize(slim_rows(docs, text, lang, source), "quality-counts")
    model = fit(slim.filter(F.col("q_n_words") >= MIN_WORDS))
    free(since)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(own.alias("q_row"), F.col(text).alias("q_text"), F.col(lang).cast("string").alias("q_lang"), F.col(source).cast("string").alias("q_source"))
    return _judged(with_counts(rows, "q_text").withColumns(vector()).drop("q_text"), model).filter("q_kept").select("q_row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir))
