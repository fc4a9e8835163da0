"""Quality rules: fixed base rules, then robust multivariate outliers.

Each text becomes a vector of transformed statistics. Per language and source, the
minimum-covariance-determinant estimate (the mean and covariance of the half of the rows
whose covariance has the smallest determinant) describes ordinary texts; rows
too far from it by Mahalanobis distance are rejected. Only DataFrame functions are used.

The half is searched for from several fixed starts: medians with equal spreads, medians with
quartile spreads, and scatters of spatial signs and of hyperbolic tangents, which outliers
hardly move. From each, concentration steps (take the nearest half, estimate anew) go on until no
determinant falls any more; of all, the smallest is taken. Covariances are regularised: each
statistic's variance is raised by a small constant, as halves without any variation in a statistic are common.

Everything is aggregated: a concentration step counts rows per group and distance bin to
find the nearest half, then sums moments of that half per group; all starts go in one pass. Statistics lie on a grid
of 1/1024, so these sums are exact in doubles and the result does not depend on the order
in which partitions are added.

Defined cases: a null or empty text has no words and fails the base rules. Null languages
and sources are values of their own. Groups with under ``min_group`` usable rows are judged
by their language, and languages with too few by all rows; with too few rows in all, only
the base rules count. Repeated rows each get their own, equal verdict. Windows of eight
words are compared by 64-bit hashes of their words' hashes.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hookloom.llm.common import BLANKS, broadcast_if_small, let, positions, split_words, whole_text
from hookloom.operators.normalize import computed_once
from hookloom.session import stage_table

SYMBOLS = "#*$%&|<>"
WINDOW = 8
GRID = 1024

# Statistics of the vector, each with the least standard deviation it is taken to have, in
# octaves. A statistic that hardly varies in ordinary texts would else reject for trifles.
FEATURES = {
    "word_length": 0.125,
    "symbol_rate": 0.5,
    "upper_share": 0.25,
    "repeat_share": 0.5,
    "mark_share": 0.25,
}
NAMES = tuple(FEATURES)
BINS_PER_OCTAVE = 32
# A determinant has stopped falling when its logarithm falls by less; distances are binned about as finely.
FALL = 1e-3
# Rows that an estimate must rest on: five for each statistic.
MIN_GROUP = 5 * len(FEATURES)


def text_statistics(text: Column) -> Column:
    """Counts of one whole text, as a struct."""
    full = whole_text(text)

    def without(marks: str) -> Column:
        return F.length(F.translate(full, marks, "")).cast("long")

    def counted(words: Column) -> Column:
        lines = F.filter(F.split(full, "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            without(BLANKS).alias("word_chars"),
            (F.length(full).cast("long") - without(SYMBOLS)).alias("n_symbols"),
            let(lines, lambda kept: F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            F.length(F.regexp_replace(full, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
            F.length(F.regexp_replace(full, r"[\p{L}\p{M}\p{N}\s]+", "")).cast("long").alias("n_marks"),
        )

    return let(split_words(full), counted)


def repeated_words(words: Column) -> Column:
    """Words inside windows of eight that the text holds at least twice."""

    def windows(hashes: Column) -> Column:
        return F.transform(
            positions(F.size(hashes) - (WINDOW - 1)),
            lambda at: F.xxhash64(*(hashes[at + step] for step in range(WINDOW))),
        )

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda value, at: F.struct(value.alias("h"), at.alias("at"))))

        def repeated(rows: Column) -> Column:
            last = F.size(rows) - 1
            twice = F.filter(
                F.transform(rows, lambda row, at: F.when(
                    (F.when(at > 0, rows[F.greatest(at - 1, F.lit(0))]["h"] == row["h"]).otherwise(False))
                    | (F.when(at < last, rows[F.least(at + 1, last)]["h"] == row["h"]).otherwise(False)),
                    row["at"],
                )),
                lambda at: at.isNotNull(),
            )
            return F.aggregate(
                F.array_sort(twice),
                F.struct(F.lit(0).alias("words"), F.lit(0).alias("end")),
                lambda total, at: F.struct(
                    (total["words"] + at + WINDOW - F.greatest(at, total["end"])).alias("words"),
                    (at + WINDOW).alias("end"),
                ),
                lambda total: total["words"],
            )

        return let(ordered, repeated)

    return let(
        F.transform(words, lambda word: F.xxhash64(word)),
        lambda hashes: let(windows(hashes), lambda rows: F.when(
            F.size(F.array_distinct(rows)) < F.size(rows), covered(rows)
        ).otherwise(0)),
    )


def feature_vector(stat: Column) -> Column:
    """The transformed statistics as whole numbers of 1/1024 octaves."""
    words = F.greatest(stat["n_words"], F.lit(1))
    chars = F.greatest(stat["word_chars"], F.lit(1))
    octaves = {
        "word_length": chars / words,
        "symbol_rate": stat["n_symbols"] / words + F.lit(1 / 32),
        "upper_share": stat["n_upper"] / chars + F.lit(1 / 8),
        "repeat_share": stat["n_repeat_words"] / words + F.lit(1 / 16),
        "mark_share": stat["n_marks"] / chars + F.lit(1 / 8),
    }
    return F.struct(*(F.round(F.log2(octaves[name]) * GRID).cast("double").alias(name) for name in NAMES))


def base_failed(stat: Column) -> Column:
    return (stat["n_words"] < 20) | (100 * stat["n_repeat_words"] > 30 * stat["n_words"])


def chi_square_quantile(probability: float, degrees: int) -> float:
    """Wilson and Hilferty's approximation."""
    spread = 2 / (9 * degrees)
    return degrees * (1 - spread + NormalDist().inv_cdf(probability) * math.sqrt(spread)) ** 3


def chi_square_cdf(value: float, degrees: int) -> float:
    spread = 2 / (9 * degrees)
    return NormalDist().cdf(((value / degrees) ** (1 / 3) - 1 + spread) / math.sqrt(spread))


def moments() -> list[Column]:
    """Sums that give mean and covariance of the rows of a group."""
    x = [F.col(f"x.{name}") for name in NAMES]
    first = [F.sum(value) for value in x]
    second = [F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i + 1)]
    return [F.count("*").alias("n"), F.array(*first).alias("s"), F.array(*second).alias("q")]


def whitening(sums: DataFrame, consistency: float) -> DataFrame:
    """Per group the centre and the inverse Cholesky factor of its covariance.

    ``consistency`` corrects the covariance of a nearest part for the tails it lacks.
    """
    d = len(NAMES)

    def at(i: int, j: int) -> int:
        return i * (i + 1) // 2 + j

    def covariance(i: int, j: int) -> Column:
        value = (F.col("q")[at(i, j)] / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * consistency
        return value + F.lit((FEATURES[NAMES[i]] * GRID) ** 2 if i == j else 0.0)

    def less(start: Column, products: list[tuple[str, str]]) -> Column:
        for one, other in products:
            start = start - F.col(one) * F.col(other)
        return start

    # Columns that depend on each other come one set after the other.
    table = sums.select("grp", "n", *((F.col("s")[i] / F.col("n")).alias(f"m{i}") for i in range(d)), "q")
    table = table.withColumns({f"c{i}{j}": covariance(i, j) for i in range(d) for j in range(i + 1)})
    for j in range(d):
        # Column j of the factor L.
        square = less(F.col(f"c{j}{j}"), [(f"l{j}{k}", f"l{j}{k}") for k in range(j)])
        table = table.withColumn(f"l{j}{j}", F.sqrt(F.greatest(square, F.lit(1.0))))
        if j + 1 < d:
            table = table.withColumns({
                f"l{i}{j}": less(F.col(f"c{i}{j}"), [(f"l{i}{k}", f"l{j}{k}") for k in range(j)]) / F.col(f"l{j}{j}")
                for i in range(j + 1, d)
            })
    for i in range(d):
        # Row i of its inverse.
        table = table.withColumns({
            f"w{i}{j}": less(F.lit(1.0 if i == j else 0.0), [(f"l{i}{k}", f"w{k}{j}") for k in range(j, i)]) / F.col(f"l{i}{i}")
            for j in range(i + 1)
        })
    logdet = sum((F.log(F.col(f"l{i}{i}")) * 2 for i in range(1, d)), F.log(F.col("l00")) * 2)
    return table.select(
        "grp", "n", logdet.alias("logdet"),
        F.array(*(F.col(f"m{i}") for i in range(d))).alias("centre"),
        F.array(*(F.col(f"w{i}{j}") for i in range(d) for j in range(i + 1))).alias("whiten"),
    )


def squared_distance() -> Column:
    """Mahalanobis distance of ``x`` from its group's centre, squared."""
    total = F.lit(0.0)
    for i in range(len(NAMES)):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col("whiten")[i * (i + 1) // 2 + j] * (F.col(f"x.{NAMES[j]}") - F.col("centre")[j])
        total = total + part * part
    return total


def _fit_once(rows: DataFrame, fitted: DataFrame, share: float | None, limit: float | None, consistency: float,
              name: str) -> DataFrame:
    """One concentration step: moments of each group's nearest rows under the last fit."""
    scored = rows.join(broadcast_if_small(fitted), "grp").withColumn("d2", squared_distance())
    if share is None:
        nearest = scored.filter(F.col("d2") <= limit)
    else:
        # The distance below which the share lies, to 1/32 octave; the whole bin is taken.
        scored = scored.withColumn(
            "bin", F.floor(F.log2(F.greatest("d2", F.lit(2.0 ** -20))) * BINS_PER_OCTAVE).cast("int")
        )
        bins = scored.groupBy("grp", "bin").agg(F.count("*").alias("n"))
        upward = Window.partitionBy("grp").orderBy("bin")
        whole = Window.partitionBy("grp")
        cut = bins.select(
            "grp", "bin", F.sum("n").over(upward).alias("below"), F.sum("n").over(whole).alias("all")
        ).filter(F.col("below") >= F.ceil(F.col("all") * share)).groupBy("grp").agg(F.min("bin").alias("cut"))
        cut = stage_table(cut, f"{name}-cut")
        nearest = scored.join(broadcast_if_small(cut), "grp").filter("bin <= cut")
    return stage_table(whitening(nearest.groupBy("grp").agg(*moments()), consistency), name)


def _middle(rows: DataFrame, name: str) -> DataFrame:
    """Per group the median ``m`` and a spread ``s`` from the quartiles, per statistic.

    They come from counts per grid cell of 1/16 octave, so no group is collected.
    """
    cells = rows.select("grp", F.posexplode(F.array(*(
        F.floor(F.col(f"x.{feature}") / (GRID // 16)) for feature in NAMES
    ))).alias("dim", "cell")).groupBy("grp", "dim", "cell").agg(F.count("*").alias("n"))
    upward = Window.partitionBy("grp", "dim").orderBy("cell")
    whole = Window.partitionBy("grp", "dim")
    reached = cells.select("grp", "dim", "cell", F.sum("n").over(upward).alias("below"), F.sum("n").over(whole).alias("all"))
    quarters = reached.groupBy("grp", "dim").agg(*(
        ((F.min(F.when(F.col("below") * 4 >= F.col("all") * k, F.col("cell"))) + F.lit(0.5)) * (GRID // 16)).alias(f"q{k}")
        for k in (1, 2, 3)
    ))
    # Quartiles of a normal distribution lie 1.349 standard deviations apart.
    floors = F.element_at(F.array(*(F.lit((FEATURES[feature] * GRID) ** 2) for feature in NAMES)), F.col("dim") + 1)
    spread = F.sqrt(F.pow((F.col("q3") - F.col("q1")) / 1.349, 2) + floors)
    each = quarters.groupBy("grp").agg(*(
        F.max(F.when(F.col("dim") == i, value)).alias(f"{part}{i}")
        for i in range(len(NAMES)) for part, value in (("m", F.col("q2")), ("s", spread))
    ))
    return stage_table(each.select(
        "grp", *(F.array(*(F.col(f"{part}{i}") for i in range(len(NAMES)))).alias(part) for part in ("m", "s"))
    ), name)


STARTS = 4


def _starts(rows: DataFrame, name: str) -> DataFrame:
    """Starts of the search per group, as fits of ``grp`` = (group, start)."""
    d = len(NAMES)
    middle = _middle(rows, f"{name}-middle")
    known = rows.join(broadcast_if_small(middle), "grp")
    z = [(F.col(f"x.{feature}") - F.col("m")[i]) / F.col("s")[i] for i, feature in enumerate(NAMES)]
    length = F.sqrt(sum((value * value for value in z[1:]), z[0] * z[0]))

    def scaled(values: list[Column]) -> Column:
        # Whole numbers again, so that sums stay exact.
        return F.struct(*(F.round(value * F.col("s")[i]).alias(feature) for i, (value, feature) in enumerate(zip(values, NAMES))))

    signs = scaled([F.when(length > 0, value / length * math.sqrt(d)).otherwise(0.0) for value in z])
    tangents = scaled([F.tanh(value) for value in z])
    moved = known.select(F.explode(F.array(
        F.struct(F.struct("grp", F.lit(2).alias("start")).alias("grp"), signs.alias("x")),
        F.struct(F.struct("grp", F.lit(3).alias("start")).alias("grp"), tangents.alias("x")),
    )).alias("one")).select("one.grp", "one.x")
    scatter = whitening(moved.groupBy("grp").agg(*moments()), 1.0).select("grp", "whiten")
    scatter = scatter.join(middle.select(F.col("grp").alias("of"), "m"), F.col("grp.grp") == F.col("of"))

    def diagonal(entries: list[Column]) -> Column:
        return F.array(*(entries[i] if i == j else F.lit(0.0) for i in range(d) for j in range(i + 1)))

    equal = diagonal([F.lit(1 / (FEATURES[feature] * GRID)) for feature in NAMES])
    quartile = diagonal([1 / F.col("s")[i] for i in range(d)])
    simple = middle.select(F.col("m").alias("centre"), F.explode(F.array(*(
        F.struct(F.struct("grp", F.lit(start).alias("start")).alias("grp"), whiten.alias("whiten"))
        for start, whiten in enumerate((equal, quartile))
    ))).alias("one"))
    return stage_table(
        simple.select("one.grp", "centre", "one.whiten").unionByName(scatter.select("grp", F.col("m").alias("centre"), "whiten")), name
    )


def smallest_determinant(rows: DataFrame, share: float, steps: int, consistency: float, name: str = "quality") -> DataFrame:
    """The fit of the smallest determinant per group, of those that concentration reaches from all starts.

    ``steps`` only guards against an endless search; a search that reaches it is still the best of what it saw.
    """
    fitted = _starts(rows, f"{name}-start")
    many = rows.select("x", F.explode(F.array(*(
        F.struct("grp", F.lit(start).alias("start")) for start in range(STARTS)
    ))).alias("grp"))
    best = None
    for step in range(steps):
        fitted = _fit_once(many, fitted, share, None, consistency, f"{name}-step{step}")
        if best is None:
            best = fitted
            continue
        latest = fitted.select("grp", F.struct("logdet", "n", "centre", "whiten").alias("new"))
        compared = best.join(latest, "grp").withColumn("fell", F.col("new.logdet") < F.col("logdet") - FALL)
        compared = stage_table(compared.select(
            "grp", "fell", *(F.when(F.col("fell"), F.col(f"new.{part}")).otherwise(F.col(part)).alias(part)
                             for part in ("n", "logdet", "centre", "whiten"))
        ), f"{name}-best")
        best = compared.drop("fell")
        if compared.filter("fell").isEmpty():
            break
    least = best.groupBy(F.col("grp.grp").alias("of")).agg(
        F.min(F.struct("logdet", F.col("grp.start").alias("start"), "n", "centre", "whiten")).alias("fit")
    )
    return stage_table(least.select(F.col("of").alias("grp"), "fit.n", "fit.logdet", "fit.centre", "fit.whiten"), f"{name}-least")


def score_quality(
    docs: DataFrame,
    carry: list[str],
    text: str = "text",
    groups: tuple[str, str] = ("lang", "source"),
    min_group: int = MIN_GROUP,
    share: float = 0.5,
    steps: int = 20,
    rejected_share: float = 1e-7,
    stage_rows: bool = True,
) -> DataFrame:
    """One row per document: ``row`` (the carried columns), ``stat``, ``failed``, ``d2`` and ``kept``.

    ``share`` is the part of a group the estimate rests on, so just under half of it may be
    junk. ``rejected_share`` is the part of ordinary rows that the cutoff may cost, were
    they normally distributed. Without ``stage_rows`` only the statistics are written for
    the fit and worked out again for the verdict, so that no copy of the texts is made.
    """
    source = docs.select(
        F.struct(*(F.col(f"`{name}`") for name in carry)).alias("row"),
        *(F.col(f"`{name}`").cast("string").alias(f"g{i}") for i, name in enumerate(groups)),
        F.col(f"`{text}`").alias("content"),
    )
    counted = computed_once(source, stat=text_statistics(F.col("content"))).drop("content")
    measured = stage_table(counted if stage_rows else counted.drop("row"), "quality-rows")

    def vectors(table: DataFrame) -> DataFrame:
        return table.withColumns({"failed": base_failed(F.col("stat")), "x": feature_vector(F.col("stat"))})

    usable = vectors(measured).filter(~F.col("failed"))
    rows = vectors(measured if stage_rows else counted)
    sizes = stage_table(usable.groupBy("g0", "g1").agg(F.count("*").alias("n")), "quality-sizes")
    levels = sizes.select(
        "g0", "g1", "n",
        F.sum("n").over(Window.partitionBy("g0")).alias("n0"),
    )
    # Groups are few against rows; their keys alone decide which group judges a row.
    levels = stage_table(levels.select(
        "g0", "g1",
        F.when(F.col("n") >= min_group, F.concat_ws("", F.lit("2"), F.to_json(F.struct("g0", "g1"))))
        .when(F.col("n0") >= min_group, F.concat_ws("", F.lit("1"), F.to_json(F.struct("g0"))))
        .otherwise("0").alias("grp"),
    ), "quality-levels")
    named = broadcast_if_small(levels).select(F.col("g0").alias("k0"), F.col("g1").alias("k1"), "grp")
    same = F.col("g0").eqNullSafe(F.col("k0")) & F.col("g1").eqNullSafe(F.col("k1"))

    # A larger group is fitted on all its rows, also those of members with a fit of their own.
    wide = usable.select("x", F.explode(F.array(
        F.concat_ws("", F.lit("2"), F.to_json(F.struct("g0", "g1"))),
        F.concat_ws("", F.lit("1"), F.to_json(F.struct("g0"))),
        F.lit("0"),
    )).alias("grp"))
    asked = broadcast_if_small(stage_table(levels.select("grp").distinct(), "quality-asked"))
    fit_rows = stage_table(wide.join(asked, "grp", "left_semi"), "quality-fit-rows")
    d = len(NAMES)
    core = chi_square_quantile(share, d)
    fitted = smallest_determinant(fit_rows, share, steps, share / chi_square_cdf(core, d + 2))
    # Rows that the estimate finds ordinary give the final one.
    ordinary = chi_square_quantile(0.975, d)
    fitted = _fit_once(
        fit_rows, fitted, None, ordinary, 0.975 / chi_square_cdf(ordinary, d + 2), "quality-final"
    )
    counted = stage_table(fit_rows.groupBy("grp").agg(F.count("*").alias("members")), "quality-members")
    fitted = fitted.join(counted.filter(F.col("members") >= min_group), "grp", "left_semi")

    # A small group's estimate is less certain: about what the F distribution adds to the tail.
    cutoff = chi_square_quantile(1 - rejected_share, d) * F.pow(F.col("n") / F.greatest(F.col("n") - d - 1, F.lit(1)), F.lit(4.5))
    judged = rows.join(named, same, "left").drop("k0", "k1")
    judged = judged.join(broadcast_if_small(stage_table(fitted, "quality-fit")), "grp", "left")
    return judged.select(
        "row", "stat", "failed", squared_distance().alias("d2"), cutoff.alias("cutoff"),
    ).select(
        "row", "stat", "failed", "d2", (~F.col("failed") & ~F.coalesce(F.col("d2") > F.col("cutoff"), F.lit(False))).alias("kept")
    )


def quality_report(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document."""
    scored = score_quality(docs, ["doc_id"])
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        *(f"stat.{name}" for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        F.col("failed").alias("base_failed"), "kept", F.round("d2", 3).alias("distance"),
    )


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns."""
    scored = score_quality(docs, docs.columns, stage_rows=False)
    return scored.filter("kept").select("row.*")
