"""Whitening against exact integers and LAPACK over the whole table at once."""

import math

import numpy as np
import pytest

from textloom.llm import queries, whiten

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=32):
    """{(id, component): (n, deviation, |whitened|, explained)} by Python's integers, and the eigenvalues."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in good]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    d = [[n * a - s for a, s in zip(r, sums)] for r in x]
    z = np.array([[a / n for a in r] for r in d])
    e, f = np.linalg.eigh(z.T @ z / n)
    e, f = e[::-1][:k], f[:, ::-1][:, :k]
    out = {}
    for (i, _), r, row in zip(good, d, z):
        for c in range(len(e)):
            out[i, c + 1] = (n, sum(a * a for a in r), abs(row @ f[:, c]) / math.sqrt(e[c]) if e[c] > 1e-9 * e[0] else None, e[c] / np.trace(z.T @ z / n))
    return out, e


def check(rows, found, k=32):
    want, e = brute(rows, k)
    got = {(r.vec_id, r.component): r for r in found}
    assert got.keys() == want.keys() and len(found) == len(want)
    apart = [c for c in range(len(e)) if all(abs(e[c] - o) > 1e-3 * e[0] for j, o in enumerate(e) if j != c)]
    for key, (n, deviation, white, explained) in want.items():
        r = got[key]
        assert (r.n, r.deviation) == (n, deviation) and math.isclose(r.explained, explained, rel_tol=1e-9, abs_tol=1e-12)
        if white is None:
            assert r.whitened is None
        elif key[1] - 1 in apart:
            assert math.isclose(abs(r.whitened), white, rel_tol=1e-7, abs_tol=1e-9)
    return got


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = queries.op12_whitening(spark, SF).collect()
    check(rows, found)
    assert len({r.identity_error for r in found}) == 1 and 0 <= found[0].identity_error < 1e-9
    w = np.zeros((len(rows), 32))
    place = {i: k for k, (i, _) in enumerate(rows)}
    for r in found:
        w[place[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(w.T @ w / len(w) - np.eye(32)).max() < 1e-9 and np.abs(w.mean(axis=0)).max() < 1e-9
    one = {r.component: r.explained for r in found}
    assert [one[c] for c in sorted(one)] == sorted(one.values(), reverse=True)


def table(n=60, d=5, seed=0, scale=(9, 5, 3, 2, 1)):
    x = np.random.default_rng(seed).standard_normal((n, d)) * np.array(scale[:d])
    return [(i, [float(v) for v in r]) for i, r in enumerate(x)]


def test_unusable_rows_and_repeats(spark):
    rows = table() + [(3, table()[3][1]), (100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan")] * 5), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    short = [(105, [1.0, 2.0])]
    found = whiten.whiten(spark.createDataFrame(rows + short, SCHEMA)).collect()
    assert len(found) == 61 * 5
    once = [r for r in found if r.vec_id != 3]
    want, _ = brute(rows)
    assert all((r.n, r.deviation) == want[r.vec_id, r.component][:2] for r in once) and sum(r.vec_id == 3 for r in found) == 10


def test_other_columns_and_ids(spark):
    df = spark.createDataFrame([(None if i == 4 else f"v{i}", v, 1.0, "x") for i, v in table()], "key string, vec array<float>, whitened double, n string")
    found = whiten.whiten(df, "key", "vec", components=2)
    assert found.columns == ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = found.collect()
    assert len(rows) == 120 and sum(r.key is None for r in rows) == 2


def test_no_rows(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        assert whiten.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_no_variance(spark):
    found = whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in found] == [(2, 0, None, None, None)] * 4


def test_fewer_rows_than_components(spark):
    rows = table(3)
    found = check(rows, whiten.whiten(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found[0, 3].whitened is None and found[0, 2].whitened is not None and found[0, 1].identity_error < 1e-9


def test_extreme_entries(spark):
    rows = [(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [0.0, 3.0])]
    found = whiten.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 6 and all(r.deviation is None for r in found if r.vec_id < 2) and all(np.isfinite(r.identity_error) for r in found)


def test_large_offset_keeps_digits(spark):
    rows = [(i, [v + 1e9 for v in r]) for i, r in table(200)]
    check(rows, whiten.whiten(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect())


def test_partitions_do_not_matter(spark):
    df = spark.createDataFrame(table(500), SCHEMA)
    a, b = ({(r.vec_id, r.component): r.whitened for r in whiten.whiten(df.repartition(p)).collect()} for p in (1, 9))
    assert all(math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-11) for k in a)


def test_parameters(spark):
    with pytest.raises(ValueError):
        whiten.whiten(spark.createDataFrame(table(), SCHEMA), components=0)
