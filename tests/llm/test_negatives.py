"""Hard negatives against brute force in whole numbers."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from landspark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, text string, score long, block long"


def by_hand(rows, every=100, positives=5, negatives_=10):
    some = []
    for vec, v, label, *_ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        some.append((vec, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if vec is not None and vec % 7 == 0 else label))
    order = lambda s: (-s[1], s[0] is None, s[0] or 0)
    out = Counter()
    for k, (anchor, a, label) in enumerate(some):
        if anchor is None or anchor % every:
            continue
        near = [(vec, sum(x * y for x, y in zip(a, v)), la) for j, (vec, v, la) in enumerate(some) if j != k]
        for pid, ps, _ in sorted((s for s in near if s[2] == label), key=order)[:positives]:
            window = sorted((s for s in near if s[2] != label and 30 * ps <= 100 * s[1] <= 90 * ps), key=order)[:negatives_]
            out.update((anchor, pid, r, n, ps, s) for r, (n, s, _) in enumerate(window, 1))
    return out


def odd_vectors(seed=3, n=400, dim=7):
    rng = random.Random(seed)
    rows = [(i * 5, [rng.choice([0.1, 0.5, -0.2, rng.uniform(-1, 1)]) for _ in range(dim)], rng.randint(0, 3)) for i in range(n)]
    rows += [(5, None, 1), (10, [1.0] * dim, None), (15, [1.0, None], 2), (20, [float("nan")] * dim, 1), (25, [float("inf")] * dim, 1), (None, [0.5] * dim, 1), (None, [0.5] * dim, 2),
             (35, [], 3), (200, [0.4] * 3, 1), (700, [0.4] * (dim + 4), 2), (-100, [0.3] * dim, 0), (-700, [-0.3] * dim, 9), (0, [0.0] * dim, 1)]
    return [(*r, "x", 1, 2) for r in rows + rows[20:60] + rows[20:30]]


@pytest.mark.parametrize("rows_per_block", [32768, 9])
def test_negatives(spark, monkeypatch, rows_per_block):
    monkeypatch.setattr(negatives, "ROWS_PER_BLOCK", rows_per_block)
    rows = odd_vectors()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = negatives.hard_negatives(frame)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = by_hand(rows)
    assert len(want) > 100 and Counter(map(tuple, got.collect())) == want
    assert negatives.hard_negatives(frame.limit(0)).collect() == []


def test_large_components_are_exact(spark):
    """Scores near 2**60 take all primes; one label holds most rows and repeats its vectors."""
    rng = random.Random(1)
    rows = [(i * 25, [rng.choice([-1, 1]) * 1.5e6 * rng.random() for _ in range(4)], 1 if i % 3 else 2) for i in range(120)]
    rows += [(i, [9e5, 8e5, -7e5, 6e5], 1) for i in range(1, 60)]
    rows = [(*r, None, None, None) for r in rows]
    assert Counter(map(tuple, negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect())) == by_hand(rows)
    with pytest.raises(ValueError):
        negatives.hard_negatives(spark.createDataFrame([(1, [1e20], 1, None, None, None)], SCHEMA))


@pytest.mark.parametrize("size,width", [(2**7, 64), (2**15, 200), (2**27, 64)])
def test_scores_against_python_numbers(size, width):
    rng = np.random.default_rng(width)
    a, b = (rng.integers(-size, size + 1, (m, width)) for m in (5, 40))
    a[0], b[0], b[1] = size, size, -size
    primes = negatives.primes_for(size * size * width)
    got = negatives.scores(negatives.residues(a, primes), negatives.residues(b, primes), primes)
    assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
    assert (negatives.scores(negatives.residues(a.astype(float), primes), negatives.residues(b, primes), primes) == got).all()
