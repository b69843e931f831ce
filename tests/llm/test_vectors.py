import hashlib
import math
import random

import numpy as np
import pytest

from loomstore.llm import vectors as V

SCHEMA = "vec_id bigint, embedding array<double>, label int, code string, v int, error string"


def brute(rows):
    """Every part against every entry, in whole numbers."""
    kept = [(i, e, y) for i, e, y in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    width = -(-max((len(e) for _, e, _ in kept), default=0) // 4) * 4
    ints = [[V.whole(x) for x in e] + [0] * (width - len(e)) for _, e, _ in kept]
    size = width // 4
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, [*kept[k][1]] + [0.0] * (width - len(kept[k][1]))))
    books = [[ints[k][p * size : (p + 1) * size] for k in order[:256]] for p in range(4)]

    def assign():
        out = []
        for x in ints:
            near = []
            for p in range(4):
                part = x[p * size : (p + 1) * size]
                near.append(min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p])))
            out.append(near)
        return out

    for _ in range(4):
        found = assign()
        for p in range(4):
            for k in range(len(books[p])):
                own = [x[p * size : (p + 1) * size] for x, f in zip(ints, found) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    sums = {}
    for (_, _, y), e in zip(kept, errors):
        sums[y] = sums.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    cap = lambda x: min(x, 2**63 - 1)
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), cap(e), cap(sums[y]), digest) for (i, _, y), f, e in zip(kept, found, errors)), key=repr)


def check(spark, rows):
    df = spark.createDataFrame([(i, e, y, "c", 1, "e") for i, e, y in rows], SCHEMA)
    got = V.encode(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 0.2) for _ in range(12)], k % 5 or None) for k in range(330)]
    rows += [(400, rows[3][1], 1), (400, rows[4][1], 1), (3, rows[5][1], None), (None, rows[6][1], 2), (None, None, 2), (401, [0.1] * 11 + [None], 1), (402, [math.nan] + [0.0] * 11, 1), (403, [math.inf] * 12, 1), (404, [], 3), (405, [0.5], 3), (406, [-1e-9] * 12, None)]
    check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1), (2, [], None)], [(5, [0.25, -0.5], 1)], [(1, [1.0] * 8, 1)] * 3 + [(2, [2.0] * 8, None)] * 2])
def test_few_rows(spark, rows):
    check(spark, rows)


def test_numbers_beyond_exact_doubles(spark):
    rng = random.Random(2)
    check(spark, [(k, [rng.choice([1e4, 3e8, 2.0**70, -3e38, 0.001]) * rng.random() for _ in range(4)], k % 2) for k in range(40)])
    check(spark, [(k, [rng.choice([1e5, -7e5, 0.3]) for _ in range(8)], k % 2) for k in range(40)])


@pytest.mark.parametrize("kind", [np.float64, object])
def test_the_search_scans_its_radius_alone_and_misses_nothing(kind):
    rng = np.random.default_rng(3)
    centres = rng.integers(-5000, 5000, (40, 6))
    book = (centres[rng.integers(0, 40, 256)] + rng.integers(-40, 40, (256, 6))).astype(np.float64)
    book[7] = book[200]  # equal entries
    x = (centres[rng.integers(0, 40, 900)] + rng.integers(-60, 60, (900, 6))).astype(np.float64)
    books = V.Codebooks(book[None].astype(kind))
    entry, apart = books.nearest(0, x.astype(kind), rng.integers(0, 256, 900))
    every = ((x[:, None] - book) ** 2).sum(2)
    assert (entry == every.argmin(1)).all() and (apart.astype(np.float64) == every.min(1)).all()
    books.scanned = 0
    again, _ = books.nearest(0, x.astype(kind), entry)
    assert (again == entry).all() and books.scanned < 0.5 * every.size  # 900 rows x 256 entries without the radius
