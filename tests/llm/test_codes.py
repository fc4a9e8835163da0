import hashlib
import math
import random

import numpy as np
import pytest

from hookloom.llm import codes
from tests.llm.edges import rows_of

SCHEMA = "vec_id long, embedding array<float>, label int, code string, part int, vector string, `a.b` string"
EXTRA = ("c", 1, "v", "y")


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(5)


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """Codes of ``(vec_id, embedding, label)`` by comparing with every entry; ids are distinct."""
    kept = [(i, [math.floor(4096 * x) for x in map(np.float32, v)], label) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[row[p] for row in cut[:entries]] for p in range(parts)]

    def distance(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest():
        return [[min(range(len(books[p])), key=lambda e: (distance(row[p], books[p][e]), e)) for p in range(parts)] for row in cut]

    for _ in range(rounds):
        codes_now = nearest()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [row[p] for row, code in zip(cut, codes_now) if code[p] == e]
                if own:
                    books[p][e] = [sum(column) // len(own) for column in zip(*own)]
    final = nearest()
    errors = [sum(distance(row[p], books[p][code[p]]) for p in range(parts)) for row, code in zip(cut, final)]
    by_label = {}
    for (_, _, label), error in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted(((i, "".join(f"{c:02x}" for c in code), error, by_label[label], digest)
                   for (i, _, label), code, error in zip(kept, final, errors)), key=repr)


def drawn(seed, rows, length=16, spread=1.0):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, spread) for _ in range(length)] for _ in range(5)]
    return [(i * 3 % 1009 - 5, [c + draw.gauss(0, 0.2) for c in draw.choice(centres)], draw.choice([None, 1, 2]))
            for i in range(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_match_brute_force(spark, seed):
    rows = drawn(seed, 400)
    rows += [(2000, None, 1), (2001, [None] * 16, 1), (2002, [float("nan")] + [0.0] * 15, 1),
             (2003, [float("-inf")] + [0.0] * 15, 2), (2004, [], 1), (2005, [-0.00001] * 16, None), (None, [0.1] * 16, 1)]
    assert rows_of(codes.code_report(table(spark, rows))) == brute_codes(rows)


def test_ties_and_repeats(spark):
    """Grids have many equal distances, and equal entries from the start."""
    draw = random.Random(3)
    rows = [(i, [draw.choice([0.0, 0.25, 0.5]) for _ in range(8)], 1) for i in range(300)]
    assert rows_of(codes.code_report(table(spark, rows))) == brute_codes(rows)
    same = [(i, [0.5] * 8, i % 2) for i in range(40)]
    assert rows_of(codes.code_report(table(spark, same))) == brute_codes(same)
    # A repeated row is coded each time and starts an entry once.
    books = codes.first_codebooks(codes.kept_vectors(table(spark, rows[:5] + rows[:5])), 8, 16)
    assert books.shape == (8, 5, 1)
    assert codes.code_report(table(spark, rows[:5] + rows[:5])).count() == 10


def test_few_rows_and_none(spark):
    few = drawn(5, 3)
    assert rows_of(codes.code_report(table(spark, few))) == brute_codes(few)
    one = few[:1]
    assert rows_of(codes.code_report(table(spark, one))) == brute_codes(one)
    empty = codes.code_report(table(spark, few).limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codes.code_report(table(spark, [(1, None, 1)])).count() == 0


def test_lengths_and_sizes(spark):
    rows = drawn(6, 50)
    odd = [(-100, [1.0] * 24, 1), *rows, (9000, [1.0] * 8, 1)]
    # The smallest id sets the length; others are left out.
    assert [r[0] for r in rows_of(codes.code_report(table(spark, odd)))] == [-100]
    assert rows_of(codes.code_report(table(spark, [*rows, (9000, [1.0] * 8, 1)]))) == brute_codes(rows)
    with pytest.raises(ValueError, match="8 parts"):
        codes.code_report(table(spark, [(1, [1.0] * 9, 1)]))
    with pytest.raises(Exception, match="components must be under"):
        codes.code_report(table(spark, [*rows, (9000, [1e30] * 16, 1)])).count()


def test_bounds_stay_true_and_save_work():
    """After any moves the bounds hold, the entry is the nearest, and most points need no list."""
    draw = np.random.default_rng(7)
    parts, entries, width, listed = 2, 16, 4, 6
    books = draw.integers(-3000, 3000, (parts, entries, width))
    part = np.tile(np.arange(parts), 2000)
    points = books[part, draw.integers(0, entries, len(part))] + draw.integers(-700, 700, (len(part), width))
    squares = np.square(points[:, None, :] - books[part]).sum(axis=2)
    code, upper, near, lower = codes._ranked(squares, listed)
    spared = []
    for step in (300, 100, 30, 0):
        moved = books + draw.integers(-step, step + 1, books.shape)
        moves = codes._roots(np.square(moved - books).sum(axis=2), up=True)
        books = moved
        lower[:, :listed] -= moves[part[:, None], near]
        lower[:, listed] -= moves.max(axis=1)[part]
        lower = np.maximum(np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1], 0)
        upper += moves[part, code]
        needed = codes.settle(points, books, part, code, upper, near, lower)
        spared.append((needed == -1).mean())
        squares = np.square(points[:, None, :] - books[part]).sum(axis=2)
        assert (code == squares.argmin(axis=1)).all()
        assert (upper.astype(float) ** 2 >= squares.min(axis=1)).all()
        for i in range(listed + 1):
            rest = squares.copy()
            np.put_along_axis(rest, code[:, None], np.iinfo(np.int64).max, axis=1)
            np.put_along_axis(rest, near[:, :i], np.iinfo(np.int64).max, axis=1)
            assert (lower[:, i].astype(np.int64) ** 2 <= rest.min(axis=1)).all()
    assert spared[-1] > 0.99 and spared[2] > 0.5


def test_roots_are_exact():
    squares = np.array([0, 1, 2, 3, 4, 10**12 - 1, 10**12, 10**12 + 1, 2**62 - 1, 2**62])
    assert codes._roots(squares, up=False).tolist() == [math.isqrt(int(s)) for s in squares]
    assert codes._roots(squares, up=True).tolist() == [math.isqrt(int(s) - 1) + 1 if s else 0 for s in squares]
