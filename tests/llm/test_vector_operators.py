"""Hard negatives and vector codes against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from vacantia.llm import hard_negatives, vector_codes, vectors

SCHEMA = "vec_id bigint, embedding array<double>, label int, row bigint, parts string, found int, error int"


def table(n=420, dim=32, seed=4):
    """Clusters, ties, repeated rows, nulls, odd numbers and lengths."""
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 0.3) for _ in range(dim)] for _ in range(6)]
    rows = []
    for k in range(n):
        label = rnd.choice([0, 0, 0, 1, 2, 9, 3])
        rows.append((k, [c + rnd.gauss(0, 0.12) for c in centres[label % 6]], label))
    rows += [(n + k, rows[k][1], rows[k + 1][2]) for k in range(30)]
    rows += [rows[50], rows[50], rows[7], (50, rows[3][1], 0), (None, rows[9][1], 0), (None, rows[10][1], 1)]
    rows += [(1000, None, 1), (1050, rows[0][1], None), (1001, [None] * dim, 1), (1002, [math.nan] * dim, 0), (1003, [math.inf] + [0.0] * (dim - 1), 0)]
    rows += [(1100, [0.0] * dim, 2), (1101, [-0.001] * dim, 2), (1102, [40.0, -900.5] + [1e-300] * (dim - 2), 1), (1150, [3.0] * dim, 1)]
    return [(*r, 1, "p", 2, 3) for r in rows]


def usable(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def brute_mine(rows, every=50, positives=5, negatives=3):
    last = float("inf")
    rows = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab, *_ in usable(rows) if lab is not None]
    out = []
    for a, (anchor, label, v) in enumerate(rows):
        if anchor is None or anchor % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), last if i is None else i, lab) for b, (i, lab, w) in enumerate(rows) if b != a]
        scored.sort(key=lambda s: s[:2])
        none = lambda i: None if i == last else i
        for ps, p, _ in [s for s in scored if s[2] == label][:positives]:
            found = [s for s in scored if s[2] != label and -50 * ps <= -100 * s[0] <= -95 * ps][:negatives]
            out += [(anchor, none(p), k + 1, none(s[1]), -ps, -s[0]) for k, s in enumerate(found)]
    return sorted(out, key=str)


def mined(df, **kwargs):
    return sorted((tuple(r) for r in hard_negatives.mine(df, **kwargs).collect()), key=str)


def test_hard_negatives_as_brute_force(spark, monkeypatch):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert mined(df) == brute_mine(rows) != []
    monkeypatch.setattr(hard_negatives, "CELL", 1 << 10)  # 32 vectors a side: many groups and slices
    assert mined(df, every=5) == brute_mine(rows, every=5)
    assert mined(df, every=7, positives=2, negatives=1) == brute_mine(rows, 7, 2, 1)


def test_hard_negatives_of_small_tables(spark):
    df = spark.createDataFrame(table(), SCHEMA)
    assert mined(df.limit(0)) == []
    assert mined(df.filter("vec_id = 50")) == []  # positives, but no other label
    assert mined(df.filter("vec_id in (1, 2, 3)")) == []
    assert mined(df.filter("embedding is null")) == []
    many = [(k, [1.0, 0.5], k % 2, 1, "p", 1, 1) for k in range(200)]
    assert mined(spark.createDataFrame(many, SCHEMA)) == []  # equal vectors score 100 percent
    zero = [(k, [0.0] * (k % 3), k % 2, 1, "p", 1, 1) for k in range(120)]
    assert mined(spark.createDataFrame(zero, SCHEMA)) == brute_mine(zero)  # no length, score 0, ties by id


@pytest.mark.parametrize("size", [10, 1000, 1 << 20, 1 << 27])
def test_scores_are_exact(size):
    rnd = np.random.default_rng(size)
    a, b = rnd.integers(-size, size, (20, 2100)), rnd.integers(-size, size, (30, 2100))
    exact = a.astype(object) @ b.T.astype(object)
    bound = int(math.sqrt(float((a.astype(float) ** 2).sum(1).max()) * float((b.astype(float) ** 2).sum(1).max()))) + 1
    primes = hard_negatives.moduli(bound)
    assert 1 < len(primes) and math.prod(primes) > 4 * bound
    assert (hard_negatives.exact_scores(hard_negatives.residues(a, primes), hard_negatives.residues(b, primes), primes) == exact).all()


def brute_codes(rows, entries=64, parts=16, rounds=2):
    rows = usable(rows)
    width = -(-max((len(r[1]) for r in rows), default=0) // parts)
    table = [(r[0], r[2], [math.floor(256 * x) for x in r[1]] + [0] * (width * parts - len(r[1]))) for r in rows]
    order = sorted(table, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    v = np.array([r[2] for r in table], np.int64).reshape(len(table), parts, width)
    books = np.array([r[2] for r in order], np.int64).reshape(len(order), parts, width)

    def assign():
        far = ((v[:, None] - books[None]) ** 2).sum(3)  # vectors, entries, parts
        return far.argmin(1), far.min(1).sum(1)

    for _ in range(rounds):
        code, _ = assign()
        new = books.copy()
        for p in range(parts):
            for e in range(len(books)):
                mine = v[code[:, p] == e, p]
                if len(mine):
                    new[e, p] = mine.sum(0) // len(mine)
        books = new
    code, error = assign()
    digest = hashlib.sha256(",".join(map(str, books.transpose(1, 0, 2).ravel().tolist())).encode()).hexdigest()
    of_label = {}
    for (_, label, _), e in zip(table, error.tolist()):
        of_label[label] = of_label.get(label, 0) + e
    return sorted(((i, "".join(f"{c:02x}" for c in row), e, of_label[label], digest) for (i, label, _), row, e in zip(table, code.tolist(), error.tolist())), key=str)


def compressed(df, **kwargs):
    return sorted((tuple(r) for r in vector_codes.compress(df, **kwargs).collect()), key=str)


def test_vector_codes_as_brute_force(spark):
    rows = [r for r in table() if r[0] != 50 or r[2] == 0]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert compressed(df) == brute_codes(rows)
    assert compressed(df, entries=5, parts=4, rounds=3) == brute_codes(rows, 5, 4, 3)
    uneven = [(k, [float(x % 5) for x in range(k, k + k % 21)], None if k % 4 else k % 3, 1, "p", 1, 1) for k in range(150)]
    assert compressed(spark.createDataFrame(uneven, SCHEMA)) == brute_codes(uneven)


def test_vector_codes_of_small_tables(spark):
    df = spark.createDataFrame(table(), SCHEMA)
    assert compressed(df.limit(0)) == []
    assert compressed(df.filter("embedding is null")) == []
    few = table()[:3]
    assert compressed(spark.createDataFrame(few, SCHEMA)) == brute_codes(few)
    bare = [(k, [], k % 2, 1, "p", 1, 1) for k in range(3)]
    assert [r[1:3] for r in compressed(spark.createDataFrame(bare, SCHEMA))] == [("00" * 16, 0)] * 3


def test_orchard_finds_the_nearest_and_skips():
    rnd = np.random.default_rng(3)
    entries = rnd.integers(-40, 40, (64, 4))
    entries[7] = entries[3]
    points = np.concatenate([rnd.integers(-60, 60, (4000, 4)), entries, np.zeros((1, 4), np.int64)])
    best, least = vector_codes.Codebook(entries).nearest(points)
    far = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (best == far.argmin(1)).all() and (least == far.min(1)).all()


def test_components_keep_whole_numbers(spark):
    rows = [(1, [0.5, -0.001, 1 / 256], 1), (2, [200.0, -1.0, 0.0], 1), (3, [1e9, -1e9, 3.0], 1), (4, [1e30], 1), (5, None, 1)]
    got = {r["vec_id"]: r for r in vectors.components_of(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    numbers = {k: vectors.matrix([r["width"]], [bytes(r["parts"])]).tolist()[0] for k, r in got.items()}
    assert numbers == {1: [128, -1, 1], 2: [51200, -256, 0]}  # longer vectors than scores can hold go
