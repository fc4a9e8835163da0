"""Mixing sources to target weights by soft membership.

A classifier trained on the label table gives every document posteriors over domains.
Nonnegative document rates are then fitted by projected-gradient least squares so that the
expected tokens per domain (rate x tokens x posterior, summed) match the target shares of
all tokens, while rates stay near one and below ``max_rate``; targets that those bounds
put out of reach are met as nearly as they allow. A document is written as many times as its rate
says; the fraction is decided by a hash of the row, so reruns agree.

Training uses at most ``train_rows`` labelled documents, those with the smallest hash of
their id, one text each; half of them give word weights, the other half calibrate the posteriors. All else
covers all documents: tokens are summed per posterior (on a grid of 1/32), and each gradient
step is one sum over these cells that brings one residual per domain to the driver. Rates are
a function of the posterior: the steps taken so far, replayed.

The grid moves a posterior by at most 1/64 before it is made to sum to one again, so the expected share of
a domain by posteriors as they are may differ from the fitted one by about that part of the mean rate; in
practice errors cancel. `mixing_summary` gives the shares reached, by posteriors as they are, beside the targets.

Defined cases: null and empty texts have no tokens and a posterior like any text without
evidence. Labels with a null in either mark are no labels; of several labels of an id, the
largest marks count, and of several texts of a labelled id the one with the smallest hash. Without labels all domains are equally likely. Repeated rows get equal
posteriors, rates and copies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from hookloom.llm.common import BLANKS, let, whole_text
from hookloom.session import stage_table

DOMAINS = ("clean", "toxic", "poor")
TARGETS = {"clean": 0.85, "toxic": 0.03, "poor": 0.12}
TRAIN_ROWS = 20_000
BUCKETS = 1 << 16
PRIOR_DOCS = 4.0
CELLS = 32
STEPS = 60
TOLERANCE = 1e-5
NEARNESS = 1e-4
RATE_STEP = 1 / (1 + NEARNESS)
# No document is written more often than this, on average.
MAX_RATE = 4.0
MARKS = b"#*$%&|<>!"


def domain_of(quality: Column, toxic: Column) -> Column:
    """Index into DOMAINS of a labelled document."""
    return F.when(toxic == 1, 1).when(quality == 0, 2).otherwise(0)


def text_buckets(text: str) -> tuple[np.ndarray, int, np.ndarray]:
    """Distinct hash buckets of the words, the words' count, and shape statistics."""
    raw = text.encode()
    words = raw.lower().split()
    if not words:
        return np.empty(0, dtype=np.int64), 0, np.zeros(3)
    hashes = np.fromiter((zlib.crc32(word) for word in words), dtype=np.int64, count=len(words)) % BUCKETS
    letters = len(raw)
    shape = np.array([
        (letters - len(raw.translate(None, MARKS))) / len(words),
        (letters - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / letters,
        float(np.mean(hashes[1:] == hashes[:-1])) if len(words) > 1 else 0.0,
    ])
    return np.unique(hashes), len(words), shape


def text_features(text: str, weights: np.ndarray) -> np.ndarray:
    """Evidence for each domain: its sum, its mean and its strongest word, and the shape."""
    buckets, count, shape = text_buckets(text)
    if not count:
        return np.zeros(3 * weights.shape[1] + 4)
    evidence = weights[buckets]
    return np.concatenate([
        evidence.sum(axis=0) / np.sqrt(len(buckets)), evidence.mean(axis=0), evidence.max(axis=0),
        np.log1p(8 * shape), [np.log1p(count)],
    ])


class DomainModel:
    """Word weights and the calibrating softmax; small enough for every task."""

    def __init__(self, weights: np.ndarray, center: np.ndarray, scale: np.ndarray, softmax: np.ndarray):
        self.weights, self.center, self.scale, self.softmax = weights, center, scale, softmax

    def posteriors(self, text: str) -> list[float]:
        features = (text_features(text, self.weights) - self.center) / self.scale
        scores = np.append(np.clip(features, -8, 8), 1.0) @ self.softmax
        odds = np.exp(scores - scores.max())
        return (odds / odds.sum()).tolist()


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, train_rows: int) -> DataFrame:
    """``label``, ``half`` and ``text`` of at most ``train_rows`` labelled ids."""
    marks = labels.filter("quality is not null and toxic is not null").groupBy("doc_id").agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic")
    ).select(
        F.col("doc_id").alias("key"), domain_of(F.col("quality"), F.col("toxic")).alias("label"),
        F.xxhash64("doc_id").alias("draw"),
    )
    drawn = F.broadcast(stage_table(marks.orderBy("draw", "key").limit(train_rows), "mixing-labels"))
    found = docs.select(F.col(f"`{doc_id}`").alias("key"), whole_text(F.col(f"`{text}`")).alias("text")).join(drawn, "key")
    # One text an id: repeated ids do not make the sample larger.
    return found.groupBy("key", "label", "draw").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select(
        "label", F.pmod(F.shiftright("draw", 1), F.lit(2)).cast("int").alias("half"), "text"
    )


def train_model(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                train_rows: int = TRAIN_ROWS) -> DomainModel:
    classes = len(DOMAINS)
    sample = stage_table(labelled_sample(docs, labels, doc_id, text, train_rows), "mixing-sample")

    def count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((BUCKETS + 1, classes), dtype=np.int64)  # the last row counts documents
        for frame in frames:
            for label, content in zip(frame["label"], frame["text"]):
                counts[text_buckets(content)[0], label] += 1
                counts[BUCKETS, label] += 1
        bucket, label = np.nonzero(counts)
        yield pd.DataFrame({"bucket": bucket, "label": label, "docs": counts[bucket, label]})

    cells = sample.filter("half = 0").mapInPandas(count_words, "bucket long, label long, docs long") \
        .groupBy("bucket", "label").agg(F.sum("docs").alias("docs")).toPandas()
    counts = np.zeros((BUCKETS + 1, classes))
    counts[cells["bucket"].to_numpy(dtype=np.int64), cells["label"].to_numpy(dtype=np.int64)] = cells["docs"]
    share = (counts[BUCKETS] + 1) / (counts[BUCKETS] + 1).sum()
    seen = counts[:BUCKETS]
    weights = np.log((seen + PRIOR_DOCS * share) / (seen.sum(axis=1, keepdims=True) + PRIOR_DOCS) / share)
    weights = weights.astype(np.float32)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({
                "label": frame["label"],
                "features": [text_features(content, weights).tolist() for content in frame["text"]],
            })

    rows = sample.filter("half = 1").mapInPandas(measure, "label int, features array<double>").toPandas()
    width = 3 * classes + 4
    if rows.empty:
        return DomainModel(weights, np.zeros(width), np.ones(width), np.zeros((width + 1, classes)))
    features = np.array(rows["features"].tolist())
    center, scale = features.mean(axis=0), features.std(axis=0) + 1e-3
    inputs = np.hstack([np.clip((features - center) / scale, -8, 8), np.ones((len(features), 1))])
    return DomainModel(weights, center, scale, fit_softmax(inputs, np.eye(classes)[rows["label"]]))


def fit_softmax(inputs: np.ndarray, truth: np.ndarray, steps: int = 800, shrink: float = 1e-3) -> np.ndarray:
    """Multinomial logistic regression by accelerated gradient descent."""
    rate = 1 / (0.5 * np.linalg.norm(inputs, 2) ** 2 / len(inputs) + shrink)
    now = np.zeros((inputs.shape[1], truth.shape[1]))
    ahead, momentum = now, 1.0
    for _ in range(steps):
        scores = inputs @ ahead
        odds = np.exp(scores - scores.max(axis=1, keepdims=True))
        slope = inputs.T @ (odds / odds.sum(axis=1, keepdims=True) - truth) / len(inputs) + shrink * ahead
        after, grown = ahead - rate * slope, (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        ahead, now, momentum = after + (momentum - 1) / grown * (after - now), after, grown
    return now


def replayed_rate(
    membership: Column, steps: list[list[float]], max_rate: float = MAX_RATE, ahead: bool = False,
) -> Column:
    """The rate of a posterior after accelerated gradient steps, each projected into [0, ``max_rate``].

    A step is one slope per domain and the momentum after it. ``ahead`` gives the point
    at which the next gradient is taken.
    """
    if not steps:
        return F.lit(1.0)
    taken = F.array(*(F.array(*(F.lit(float(value)) for value in step)) for step in steps))

    def moved(state: Column, step: Column) -> Column:
        slope = F.lit(0.0)
        for j in range(len(steps[0]) - 1):
            slope = slope + membership[j] * step[j]
        free = state["ahead"] - RATE_STEP * (slope + NEARNESS * (state["ahead"] - 1))
        return let(F.least(F.lit(float(max_rate)), F.greatest(F.lit(0.0), free)), lambda rate: F.struct(
            rate.alias("rate"), (rate + step[len(steps[0]) - 1] * (rate - state["rate"])).alias("ahead")
        ))

    start = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead"))
    return F.aggregate(taken, start, moved, lambda state: state["ahead" if ahead else "rate"])


def fit_rates(cells: DataFrame, targets: list[float], max_rate: float = MAX_RATE) -> list[list[float]]:
    """The accelerated projected-gradient steps that move all rates from one to the least-squares fit.

    ``cells`` has ``membership`` (posteriors) and ``tokens``. With w the share of a cell in
    all tokens, the fit minimises half the sum over domains of (expected share - target)^2
    / scale plus NEARNESS/2 times the sum of w (rate - 1)^2. The scale of a domain is its
    share before or its target, whichever is larger, so no curvature exceeds one and a unit
    step always descends. Slopes are the residuals over their scales.
    """
    k = len(targets)
    p = [F.col("membership")[j] for j in range(k)]
    steps: list[list[float]] = []
    scale, before, inertia = None, None, 1.0
    for _ in range(STEPS):
        rate = replayed_rate(F.col("membership"), steps, max_rate, ahead=True)
        reached = cells.select("tokens", "membership", rate.alias("rate")).agg(F.sum("tokens").alias("all"), *(
            F.sum(F.col("tokens") * F.col("rate") * p[j]).alias(f"d{j}") for j in range(k)
        )).first()
        if not reached["all"]:
            return []
        shares = np.array([reached[f"d{j}"] / reached["all"] for j in range(k)])
        if scale is None:
            scale = np.maximum(np.maximum(shares, np.array(targets)), 1e-12)
        elif np.abs(shares - before).max() < TOLERANCE:
            break
        before, grown = shares, (1 + np.sqrt(1 + 4 * inertia ** 2)) / 2
        steps.append([*((shares - np.array(targets)) / scale).tolist(), (inertia - 1) / grown])
        inertia = grown
    return steps


def mix(
    docs: DataFrame, labels: DataFrame, carry: list[str], targets: dict[str, float] = TARGETS,
    doc_id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS, max_rate: float = MAX_RATE,
    stage_rows: bool = True,
) -> DataFrame:
    """One row per document: ``row`` (the carried columns), ``id``, ``tokens``, ``posterior``,
    ``rate`` and ``copies``.

    Without ``stage_rows`` posteriors are worked out again for the result, so that no copy of
    the carried columns is made.
    """
    if set(targets) != set(DOMAINS) or any(share < 0 for share in targets.values()) or not sum(targets.values()):
        raise ValueError(f"targets must give a share to each of {DOMAINS}")
    shares = [targets[name] / sum(targets.values()) for name in DOMAINS]
    model = train_model(docs, labels, doc_id, text, train_rows)

    @F.pandas_udf(ArrayType(DoubleType()))
    def posteriors(texts: pd.Series) -> pd.Series:
        return pd.Series([model.posteriors(content) for content in texts])

    content = whole_text(F.col(f"`{text}`"))
    rows = docs.select(
        F.struct(*(F.col(f"`{name}`") for name in carry)).alias("row"),
        F.col(f"`{doc_id}`").alias("id"),
        F.size(F.array_remove(F.split(F.translate(content, BLANKS, " " * len(BLANKS)), " +"), "")).cast("long")
        .alias("tokens"),
        (F.pmod(F.xxhash64(F.lit("mix"), F.col(f"`{doc_id}`"), F.col(f"`{text}`")), F.lit(1 << 32)) / float(1 << 32))
        .alias("draw"),
        posteriors(content).alias("posterior"),
    )
    if stage_rows:
        rows = stage_table(rows, "mixing-rows")
    # Posteriors on a grid, summing to one again.
    rounded = F.transform("posterior", lambda value: F.round(value * CELLS))
    rows = rows.withColumn("cell", rounded)
    cells = stage_table(rows.groupBy("cell").agg(F.sum("tokens").alias("tokens")).select(
        membership_of("cell").alias("membership"), "tokens"
    ), "mixing-cells")
    steps = fit_rates(cells, shares, max_rate)
    rows = rows.withColumn("rate", F.round(replayed_rate(membership_of("cell"), steps, max_rate), 9))
    whole = F.floor("rate")
    return rows.select(
        "row", "id", "tokens", "posterior", "rate",
        (whole + (F.col("draw") < F.col("rate") - whole).cast("int")).cast("int").alias("copies"),
    )


def membership_of(cell: str) -> Column:
    total = F.aggregate(cell, F.lit(0.0), lambda sum_, value: sum_ + value)
    return F.transform(cell, lambda value: value / total)


def mixing_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Posteriors, rate and copies of every document."""
    mixed = mix(docs, labels, ["doc_id"])
    return mixed.select(
        F.col("id").alias("doc_id"), "tokens",
        *(F.round(F.col("posterior")[j], 6).alias(f"p_{name}") for j, name in enumerate(DOMAINS)),
        F.round("rate", 6).alias("rate"), "copies",
    )


def mixing_summary(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, max_rate: float = MAX_RATE,
) -> DataFrame:
    """Per domain its share of tokens before, its target, what rates reach by expectation and what is written;
    and how many documents are written other than once. Targets out of reach show here."""
    rows = mix(docs, labels, ["doc_id"], targets, max_rate=max_rate)
    k = len(DOMAINS)
    sums = rows.agg(
        F.sum("tokens").alias("all"), F.count_if(F.col("copies") != 1).alias("changed"),
        *(F.sum(F.col("tokens") * F.col("posterior")[j]).alias(f"before{j}") for j in range(k)),
        *(F.sum(F.col("tokens") * F.col("rate") * F.col("posterior")[j]).alias(f"reached{j}") for j in range(k)),
        *(F.sum(F.col("tokens") * F.col("copies") * F.col("posterior")[j]).alias(f"written{j}") for j in range(k)),
    )
    total = sum(targets.values())
    return sums.select(F.inline(F.array(*(
        F.struct(
            F.lit(name).alias("domain"), F.lit(targets[name] / total).alias("target"),
            *(F.try_divide(F.col(f"{part}{j}"), F.col("all")).alias(part) for part in ("before", "reached", "written")),
            F.col("changed").alias("documents_changed"),
        ) for j, name in enumerate(DOMAINS)
    ))))


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The documents, each as often as its rate says, with their columns."""
    mixed = mix(docs, labels, docs.columns, targets, stage_rows=False)
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).select("row.*")
