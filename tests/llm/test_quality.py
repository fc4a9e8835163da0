import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hookloom.llm import quality
from tests.llm.edges import documents, no_documents, prose, rows_of

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = {w: windows.count(w) for w in set(windows)} if len(windows) < 400 else None
    if seen is None:
        seen = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
    hit = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
    )


def test_counts_match_brute_force(spark):
    random.seed(2)
    texts = [
        "a b\x0bc\x0c d\re", "É#ü* <x>\n\n x \nx\n x", "one two three four five six seven eight " * 3, "x " * 40,
        " non breaking stays one", "||||", *(
            " ".join(random.choice("abc") for _ in range(random.randint(5, 60))) for _ in range(30)
        ),
    ]
    docs = documents(spark, *texts)
    got = docs.select("text", quality.text_statistics(F.col("text")).alias("s")).select(
        "text", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words"
    ).collect()
    for text, *counts in got:
        assert tuple(counts) == brute_counts(text), text


def test_report_keeps_every_row_and_rejects_outliers(spark):
    clean = [prose(i, 60 + i % 90) for i in range(300)]
    junk = [" ".join(w + random.choice(["%%%", "***", "&&&"]) for w in prose(1000 + i, 80).split()) for i in range(20)]
    loud = [prose(2000 + i, 80).upper().replace(" ", "!! ") for i in range(20)]
    got = {r["doc_id"]: r for r in quality.quality_report(documents(spark, *clean, *junk, *loud)).collect() if r["doc_id"]}
    assert len(quality.quality_report(documents(spark, *clean)).collect()) == len(clean) + 9
    assert all(got[i]["kept"] for i in range(1, 301))
    assert not any(got[i]["kept"] for i in range(301, 341))
    assert not any(got[i]["base_failed"] for i in range(301, 341))
    assert got[901]["base_failed"] and not got[901]["kept"] and got[901]["n_words"] == 0
    assert set(quality.quality_report(documents(spark, *clean)).columns) >= {
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    }


def test_few_rows_leave_only_the_base_rules(spark):
    for row in quality.quality_report(documents(spark, prose(1, 50), "%%% " * 30)).collect():
        assert row["kept"] == (not row["base_failed"])


def test_filter_returns_the_documents_columns(spark):
    docs = documents(spark, *(prose(i, 50) for i in range(5)))
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept) == [r for r in rows_of(docs) if r[1] and len(r[1].split()) >= 20]


def test_empty_table(spark):
    assert quality.quality_report(no_documents(spark)).collect() == []
    assert quality.quality_filter(no_documents(spark)).collect() == []


def vectors_table(spark, rows):
    return spark.createDataFrame([(grp, *map(float, r)) for grp, r in rows], "grp string, " + ", ".join(
        f"f{i} double" for i in range(5)
    )).select("grp", F.struct(*(F.col(f"f{i}").alias(n) for i, n in enumerate(quality.NAMES))).alias("x"))


FLOORS = np.diag([(quality.FEATURES[n] * quality.GRID) ** 2 for n in quality.NAMES])


def brute_logdet(x):
    """Smallest log determinant of the regularised covariance over all halves of the rows."""
    half = math.ceil(len(x) / 2)
    chosen = np.array(list(combinations(range(len(x)), half)))
    best = np.inf
    for part in np.array_split(chosen, max(1, len(chosen) // 20_000)):
        near = x[part]
        centred = near - near.mean(axis=1, keepdims=True)
        cover = np.einsum("sni,snj->sij", centred, centred) / half + FLOORS
        best = min(best, np.linalg.slogdet(cover)[1].min())
    return best


def test_search_finds_the_smallest_determinant(spark):
    """Small groups against every half there is: ordinary rows, far ones, and outliers in a tight heap."""
    draw = np.random.default_rng(11)
    groups = {}
    for i, (near, far, spread) in enumerate([(16, 0, 1), (12, 4, 3000), (11, 6, 40), (10, 8, 900), (9, 8, 30)]):
        own = draw.normal(size=(near, 5)) @ np.diag([900, 1500, 700, 900, 800])
        groups[f"g{i}"] = np.round(np.vstack([own, draw.normal(size=(far, 5)) * spread + 9000]))
    rows = vectors_table(spark, [(name, r) for name, x in groups.items() for r in x])
    found = {r.grp: r for r in quality.smallest_determinant(rows, 0.5, 20, 1.0, "t").collect()}
    single = quality._starts(rows, "u").filter("grp.start = 0").select("grp.grp", "centre", "whiten")
    for step in range(4):
        single = quality._fit_once(rows, single, 0.5, None, 1.0, f"u{step}")
    single = {r.grp: r.logdet for r in single.collect()}
    for name, x in groups.items():
        least = brute_logdet(x)
        # Bins of distance may take in a row more than half, which costs a little.
        assert found[name].logdet <= least + 1.2 and found[name].n <= math.ceil(len(x) / 2) + 3
        assert found[name].logdet <= single[name] + 1e-9
    # Where ordinary rows are the majority, the estimate rests on them.
    for name in ("g0", "g1", "g2"):
        assert abs(np.array(found[name].centre)).max() < 3000


def test_groups_over_and_under_the_limit_are_judged_by_their_own_or_their_language(spark):
    """A source whose ordinary texts are long-worded is judged by itself once it has enough of them."""
    def table(count):
        rows = [(i, prose(i, 80), "en", "web") for i in range(200)]
        rows += [(1000 + i, " ".join(w * 6 for w in prose(i, 80).split()), "en", "lab") for i in range(count)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")

    own = {r.doc_id: r.kept for r in quality.quality_report(table(quality.MIN_GROUP)).collect()}
    assert all(own.values())
    few = {r.doc_id: r.kept for r in quality.quality_report(table(quality.MIN_GROUP - 1)).collect()}
    assert all(kept == (doc_id < 1000) for doc_id, kept in few.items())


def test_determinant_estimate_matches_numpy(spark):
    """The final distances agree with the same concentration steps done in numpy."""
    draw = np.random.default_rng(1)
    base = draw.normal(size=(400, 5)) @ np.diag([300, 700, 300, 600, 300])
    x = np.round(np.vstack([base, draw.normal(9000, 50, size=(80, 5))]))
    rows = vectors_table(spark, [("g", r) for r in x])
    fitted = quality._starts(rows, "t").filter("grp.start = 0").select("grp.grp", "centre", "whiten")
    for step in range(3):
        fitted = quality._fit_once(rows, fitted, 0.5, None, 1.0, f"t{step}")
    fit = fitted.first()
    got = np.array(rows.join(fitted, "grp").select(quality.squared_distance()).toPandas()).ravel()

    floors = FLOORS
    cells = np.floor(x / (quality.GRID // 16))
    centre = np.array([(np.sort(c)[math.ceil(len(c) / 2) - 1] + 0.5) * (quality.GRID // 16) for c in cells.T])
    cover = floors
    for _ in range(3):
        d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cover), x - centre)
        bins = np.floor(np.log2(np.maximum(d2, 2.0 ** -20)) * quality.BINS_PER_OCTAVE)
        near = x[bins <= np.sort(bins)[math.ceil(len(x) / 2) - 1]]
        centre, cover = near.mean(axis=0), np.cov(near.T, bias=True) + floors
    want = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cover), x - centre)
    assert np.allclose(fit["centre"], centre)
    assert np.allclose(np.sort(got), np.sort(want), rtol=1e-6)
    assert np.sort(want)[400:].min() > 100 > np.sort(want)[:400].max()


def test_chi_square_quantile():
    assert quality.chi_square_quantile(0.975, 5) == pytest.approx(12.83, abs=0.05)
    assert quality.chi_square_cdf(4.35, 5) == pytest.approx(0.5, abs=0.01)


def test_main_path_has_no_python(spark):
    plan = quality.quality_report(documents(spark, prose(1, 30)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
