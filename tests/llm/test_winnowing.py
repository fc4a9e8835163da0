import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hookloom.llm import winnowing
from tests.llm.edges import documents, no_documents, prose, rows_of

MASK = (1 << 64) - 1


def brute_hash(points):
    inverse = pow(winnowing._BASE, -1, 1 << 64)
    h = sum((c + 1) * pow(inverse, i, 1 << 64) for i, c in enumerate(points)) & MASK
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & MASK
    return h ^ (h >> 31)


def brute_winnow(text, gram=16, window=25):
    """Window by window, as (hash, position)."""
    points = [ord(c) for c in text]
    if not points:
        return []
    gram = min(gram, len(points))
    hashes = [brute_hash(points[i:i + gram]) for i in range(len(points) - gram + 1)]
    chosen = set()
    for start in range(max(len(hashes) - window + 1, 1)):
        here = range(start, min(start + window, len(hashes)))
        chosen.add(min(here, key=lambda i: (hashes[i], -i)))
    return [(hashes[i], i) for i in sorted(chosen)]


def brute_likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return 1.0 if not a | b else len(a & b) / len(a | b)


def brute_pack(chosen):
    steps = [p - q for (_, p), q in zip(chosen, [0, *(p for _, p in chosen)])]
    return "".join(f"{h >> 32:08x}{step:02x}" for (h, _), step in zip(chosen, steps))


def brute_report(rows):
    """Rows ``(doc_id, text)`` whose order is settled by their ids or by being equal."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        own, changed = brute_winnow(text), brute_winnow(edited)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), brute_pack(own), brute_pack(changed),
                    brute_likeness(own, changed), brute_likeness(own, brute_winnow(following))))
    return sorted(out, key=repr)


TEXTS = ["", "a", "short", "fifteen letters", "sixteen letters!", "ab" * 60, "x" * 200, prose(1, 40), prose(1, 40) + " more",
         prose(2, 80), "Häuser 漢字 \U0001f600 " * 12, prose(3, 300)]


@pytest.mark.parametrize("text", TEXTS)
def test_winnowing_matches_windows_one_by_one(text):
    for gram, window in ((16, 25), (5, 4), (3, 1), (1, 7)):
        hashes, at = winnowing.winnow(text, gram, window)
        assert list(zip(hashes.tolist(), at.tolist())) == brute_winnow(text, gram, window)
        # Long texts are taken in blocks.
        again = winnowing.winnow(text, gram, window, block=window + 3)
        assert [x.tolist() for x in again] == [hashes.tolist(), at.tolist()]
    hashes, at = winnowing.winnow(text)
    assert winnowing.unpacked(winnowing.packed(hashes, at)) == ([int(h) >> 32 for h in hashes], at.tolist())


def test_shared_passages_are_always_found():
    draw = random.Random(5)
    shortest = winnowing.WINDOW + winnowing.GRAM - 1
    for i in range(200):
        passage = "".join(draw.choice("abcd ") for _ in range(shortest))
        left, right = prose(i, 20) + passage + prose(i + 100, 9), prose(i + 200, 5) + passage + prose(i + 300, 30)
        (ours, at), (theirs, there) = winnowing.winnow(left), winnowing.winnow(right)
        common, mine, other = np.intersect1d(ours, theirs, return_indices=True)
        assert len(common)
        for p, q in zip(at[mine], there[other]):
            assert left[p:p + winnowing.GRAM] == right[q:q + winnowing.GRAM]


def test_fingerprint_column(spark):
    row = spark.createDataFrame([(1, prose(1, 40)), (2, None)], "id int, text string").select(
        "id", winnowing.fingerprints(F.col("text")).alias("prints")).orderBy("id").collect()
    assert [(p.hash % 2**64, p.position) for p in row[0].prints] == brute_winnow(prose(1, 40)) and row[1].prints == []


def unique_rows(spark, *texts):
    """The awkward documents, without those whose equal ids have different texts."""
    return documents(spark, *texts).filter("doc_id IS NULL AND text IS NULL OR doc_id IS NOT NULL AND (doc_id <> 904 OR lang = 'en')")


def test_report_matches_brute_force(spark):
    docs = unique_rows(spark, *TEXTS, *(prose(i, 60) for i in range(40)))
    source = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(winnowing.fingerprint_report(docs)) == brute_report(source)


def test_equal_ids_with_other_texts_have_a_fixed_order(spark):
    docs = documents(spark, *TEXTS)
    first = rows_of(winnowing.fingerprint_report(docs))
    assert len(first) == docs.count()
    assert first == rows_of(winnowing.fingerprint_report(docs.repartition(5)))
    by_text = {}
    for row in docs.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id").collect():
        by_text.setdefault(row.text, set()).add(row.doc_id)
    prints = {}
    for doc_id, _, _, fingerprint, *_ in first:
        prints.setdefault(fingerprint, set()).add(doc_id)
    assert {d for d in prints[""]} == by_text[""]


def test_very_many_copies_of_one_row(spark):
    """A third of the rows being one row, and all rows being one."""
    rows = [(7, prose(1, 30))] * 300 + [(i, prose(i, 30)) for i in range(100, 700)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert rows_of(winnowing.fingerprint_report(table)) == brute_report(rows)
    same = [(None, "none of these has an id, all are alike")] * 100
    table = spark.createDataFrame(same, "doc_id long, text string").repartition(6)
    assert rows_of(winnowing.fingerprint_report(table)) == brute_report(same)


def test_one_row_and_none(spark):
    one = [(3, prose(4, 50))]
    assert rows_of(winnowing.fingerprint_report(spark.createDataFrame(one, "doc_id int, text string"))) == brute_report(one)
    empty = winnowing.fingerprint_report(no_documents(spark))
    assert empty.count() == 0 and len(empty.columns) == 7


def test_likeness_tells_edits_from_other_texts(spark):
    table = spark.createDataFrame([(i, prose(i, 150)) for i in range(200)], "doc_id long, text string")
    got = winnowing.fingerprint_report(table).agg(F.min("near_edited"), F.max("near_next"), F.avg("near_edited")).first()
    assert got[0] > 0.15 and got[1] < 0.1 and abs(got[2] - 1 / 3) < 0.1


def test_texts_are_shuffled_once(spark):
    docs = spark.createDataFrame([(i, prose(i, 20)) for i in range(300)], "doc_id long, text string")
    plan = winnowing.fingerprint_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert np.array_equal(winnowing.winnow("x" * 100)[0], winnowing.winnow("x" * 100)[0])
