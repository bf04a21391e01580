import hashlib
import math

import numpy as np
import pytest

from pagewright.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int, part int"


def plain(rows):
    """Codes, errors and digest by whole distance matrices and Python integers; rows are (vec_id, vector, label)."""
    vectors = [[math.floor(1024 * x) for x in r[1]] for r in rows]
    width = len(vectors[0]) // 4
    codes, errors, numbers = [""] * len(rows), [0] * len(rows), []
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    for p in range(4):
        parts = [v[p * width:(p + 1) * width] for v in vectors]
        book = [list(parts[k]) for k in order[:256]]
        for k in range(5):
            best = [min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book)) for x in parts]
            if k == 4:
                break
            for e in range(len(book)):
                mine = [x for x, (_, f) in zip(parts, best) if f == e]
                if mine:
                    book[e] = [sum(column) // len(mine) for column in zip(*mine)]
        codes = [c + f"{e:02x}" for c, (_, e) in zip(codes, best)]
        errors = [x + d for x, (d, _) in zip(errors, best)]
        numbers += [x for c in book for x in c]
    by_label = {}
    for r, e in zip(rows, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()
    return sorted((r[0], c, e, by_label[r[2]], digest) for r, c, e in zip(rows, codes, errors))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_codes_match_plain_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in np.float32(rng.integers(-3, 4, 8) / 7)], [None, 1, 2][i % 3]) for i in rng.permutation(330)]
    assert got(vector_codes.compress(frame(spark, rows))) == plain(rows)


def test_hot_vector_and_few_rows(spark):
    rows = [(i, [0.25, -0.5, 1.0, 0.0], 1) for i in range(200)] + [(200 + i, [i / 10, -i / 9, 0.1, i / 8], 2) for i in range(40)]
    assert got(vector_codes.compress(frame(spark, rows))) == plain(rows)


def test_incomplete_vectors_go(spark):
    whole = [(i, [i / 3, -i / 5, 0.5, i / 7], i % 2) for i in range(30)]
    nan, inf = float("nan"), float("inf")
    broken = [(100, None, 1), (101, [None, 1.0, 1.0, 1.0], 1), (102, [nan, 0.0, 0.0, 0.0], 1), (103, [0.0, inf, 0.0, 0.0], None), (-1, [0.0, 0.0, -inf, 0.0], 0),
              (104, [], 1), (105, [1.0] * 5, 1)]
    assert got(vector_codes.compress(frame(spark, whole + broken))) == plain(whole)


def test_repeated_and_missing_ids(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0], None), (1, [0.0, 2.0, 3.0, 4.0], None), (None, [9.0, 9.0, 9.0, 9.0], 2), (2, [5.0, 6.0, 7.0, 8.0], 2)]
    out = vector_codes.compress(frame(spark, rows * 200)).collect()
    assert len(out) == 800 and {r["vec_id"] for r in out} == {1, 2, None}
    assert vector_codes.compress(frame(spark, [(None, [1.0] * 4, 1)])).count() == 0
    assert vector_codes.compress(frame(spark, [(1, [1.0] * 4, 1)]).limit(0)).count() == 0


def test_huge_components_and_odd_lengths(spark):
    rows = [(1, [3e38, -3e38, 1.0, 2.0, 5.0], 1), (2, [0.0] * 5, 1)]
    out = vector_codes.compress(frame(spark, rows)).collect()
    assert {r["vec_id"]: r["code"] for r in out} == {1: "00000000", 2: "01010100"}  # the last part is all filling
    assert all(r["error"] == 0 for r in out)


@pytest.mark.parametrize("spread", [3, 10**7])
def test_gathers_equal_direct_distances(spread):
    rng = np.random.default_rng(1)
    part, entries = rng.integers(-spread, spread, (700, 5)), rng.integers(-spread, spread, (40, 5))
    index, distance = vector_codes.nearest(part, entries)
    full = ((part[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (index == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def test_tabulated_values_are_each_distinct_integer_once():
    values, code = vector_codes.dictionary(np.array([5, -2, 5, 7, -2]))
    assert values.tolist() == [-2, 5, 7] and values[code].tolist() == [5, -2, 5, 7, -2]
