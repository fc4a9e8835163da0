import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hookloom.llm import mixing
from tests.llm.edges import documents, no_documents, prose


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def corpus(spark):
    """Three kinds of text; two thirds are labelled, and held out rows are not."""
    draw, texts, marks = random.Random(1), [], []
    for i in range(600):
        words = prose(i, 60).split()
        if i % 3 == 1:
            words[::9] = ["scum"] * len(words[::9])
        if i % 3 == 2:
            words = [w + draw.choice(["%%%", "***"]) for w in words]
        texts.append(" ".join(words))
        if i < 450:
            marks.append((i + 1, int(i % 3 != 2), int(i % 3 == 1), "clash"))
    marks += [(1, None, 0, None), (None, 1, 1, None), (2, 1, 1, None)]
    return documents(spark, *texts), labels(spark, marks)


def test_held_out_accuracy_and_rows(spark, corpus):
    docs, marks = corpus
    rows = mixing.mixing_report(docs, marks).collect()
    assert len(rows) == docs.count()
    held_out = [r for r in rows if r["doc_id"] and 450 < r["doc_id"] <= 600]
    right = sum(
        max(mixing.DOMAINS, key=lambda name: r[f"p_{name}"]) == mixing.DOMAINS[(r["doc_id"] - 1) % 3] for r in held_out
    )
    assert right >= 0.9 * len(held_out)
    assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in rows)
    twice = [tuple(r) for r in rows if r["doc_id"] == 904]
    assert len(twice) == 3 and len(set(twice)) == 2
    null_text = next(r for r in rows if r["doc_id"] == 901)
    assert null_text["tokens"] == 0 and null_text["rate"] >= 0


def test_rates_reach_the_targets(spark):
    draw = np.random.default_rng(2)
    p = draw.dirichlet([0.5, 0.4, 0.3], 300)
    tokens = draw.integers(1, 900, 300)
    cells = spark.createDataFrame([(r.tolist(), int(t)) for r, t in zip(p, tokens)], "membership array<double>, tokens long")
    for targets in ([0.7, 0.1, 0.2], [0.1, 0.3, 0.6]):
        steps = mixing.fit_rates(cells, targets)
        rate = np.array([r[0] for r in cells.select(mixing.replayed_rate(F.col("membership"), steps)).collect()])
        assert rate.min() >= 0
        assert np.allclose((rate * tokens) @ p / tokens.sum(), targets, atol=1e-3)


def test_filter_writes_whole_copies(spark, corpus):
    docs, marks = corpus
    mixed = mixing.mix_documents(docs, marks)
    assert mixed.columns == docs.columns
    report = mixing.mixing_report(docs, marks)
    assert mixed.count() == report.agg(F.sum("copies")).first()[0]


def test_nothing_labelled_and_nothing_there(spark):
    docs = documents(spark, prose(1, 20), prose(2, 30))
    for row in mixing.mixing_report(docs, labels(spark, [])).collect():
        assert row["p_clean"] == pytest.approx(1 / 3, abs=1e-6)
    assert mixing.mixing_report(no_documents(spark), labels(spark, [(1, 1, 0, "")])).collect() == []


def test_targets_are_checked(spark):
    with pytest.raises(ValueError):
        mixing.mix(no_documents(spark), labels(spark, []), ["doc_id"], {"clean": 1.0})


def test_repeated_ids_do_not_grow_the_sample(spark):
    docs = spark.createDataFrame([(7, prose(i, 20)) for i in range(300)] + [(8, "b")], "doc_id long, text string")
    marks = labels(spark, [(7, 1, 0, ""), (8, 0, 0, "")])
    assert mixing.labelled_sample(docs, marks, "doc_id", "text", 1).count() == 1
    sample = mixing.labelled_sample(docs, marks, "doc_id", "text", 10)
    assert sample.count() == 2
    assert sample.collect() == mixing.labelled_sample(docs.repartition(5), marks, "doc_id", "text", 10).collect() or \
        sorted(map(str, sample.collect())) == sorted(map(str, mixing.labelled_sample(docs.repartition(5), marks, "doc_id", "text", 10).collect()))


def test_summary_shows_what_targets_are_reached(spark, corpus):
    docs, marks = corpus
    # Half of all tokens lie in one very long text, which puts the share of clean ones out of reach.
    missed = {r.domain: r for r in mixing.mixing_summary(docs, marks).collect()}
    assert missed["clean"].reached < 0.8 < missed["clean"].target
    docs = docs.filter("doc_id < 900")
    by_domain = {r.domain: r for r in mixing.mixing_summary(docs, marks).collect()}
    assert set(by_domain) == set(mixing.DOMAINS)
    assert all(abs(r.reached - r.target) < 0.03 and abs(r.written - r.reached) < 0.1 for r in by_domain.values())
    assert abs(by_domain["toxic"].before - by_domain["toxic"].target) > 0.1 and by_domain["toxic"].documents_changed > 50
    # Out of reach: no document may be written more than once.
    held = {r.domain: r for r in mixing.mixing_summary(docs, marks, {"clean": 0, "toxic": 1, "poor": 0}, max_rate=1.0).collect()}
    assert held["toxic"].reached < 0.6
