import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from mediaseries.operators import correlate
from mediaseries.operators.correlate import (
    _blocks,
    average_ranks,
    codes,
    correlation_extremes,
    kendall_tau_b,
    lagged_correlation,
    lagged_pairs,
)


def frame(spark, x, y, key=None):
    rows = [(i, None if pd.isna(a) else float(a), None if pd.isna(b) else float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "i long, x double, y double")
    return df


def brute_tau(x, y):
    n, s, tx, ty = len(x), 0, 0, 0
    for i in range(n):
        for j in range(i):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            s, tx, ty = s + a * b, tx + (a != 0), ty + (b != 0)
    return s / np.sqrt(tx * ty) if tx and ty else None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=40))
def test_kendall_is_the_sign_formula(pairs):
    x, y = np.array([p[0] for p in pairs], float), np.array([p[1] for p in pairs], float)
    got, want = kendall_tau_b(x, y), brute_tau(x, y)
    assert (got is None) == (want is None)
    if want is not None:
        assert got == pytest.approx(want)


def expected(x, y, k, method):
    a, b = pd.Series(x, dtype=float), pd.Series(y, dtype=float).shift(-k)
    ok = a.notna() & b.notna()
    a, b = a[ok], b[ok]
    if len(a) < 2 or a.nunique() < 2 or b.nunique() < 2:
        return None
    if method == "kendall":
        return brute_tau(a.to_numpy(), b.to_numpy())
    if method == "spearman":
        a, b = a.rank(), b.rank()
    return float(np.corrcoef(a, b)[0, 1])


def test_all_methods_with_ties_and_gaps(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 6, 40).astype(float), rng.integers(0, 9, 40).astype(float)
    x[[3, 17]] = np.nan
    y[[0, 21]] = np.nan
    got = {(r.method, r.offset): r.correlation for r in lagged_correlation(frame(spark, x, y), "x", "y", range(-45, 46, 5)).collect()}
    assert len(got) == 3 * 19
    for (method, k), value in got.items():
        want = expected(x, y, k, method)
        assert (value is None) == (want is None), (method, k)
        if want is not None:
            assert value == pytest.approx(want)
            assert -1 - 1e-9 <= value <= 1 + 1e-9


def test_windows_are_cut_after_the_shift(spark):
    rng = np.random.default_rng(2)
    x, y = rng.random(50), rng.random(50)
    got = lagged_correlation(frame(spark, x, y), "x", "y", [-3, 0, 7], methods=["spearman"], window_sizes=[12, 50]).collect()
    assert len(got) == 3 * (5 + 1)
    shifted = {k: pd.Series(y).shift(-k) for k in (-3, 0, 7)}
    for r in got:
        part = slice(r.window * r.window_size, (r.window + 1) * r.window_size)
        a, b = pd.Series(x)[part], shifted[r.offset][part]
        ok = b.notna()
        if ok.sum() < 2:
            assert r.correlation is None
        else:
            assert r.correlation == pytest.approx(np.corrcoef(a[ok].rank(), b[ok].rank())[0, 1])


def test_properties(spark):
    rng = np.random.default_rng(3)
    x, y = rng.random(60), rng.random(60)
    own = {(r.method, r.offset): r.correlation for r in lagged_correlation(frame(spark, x, x), "x", "y", range(-4, 5)).collect()}
    for m in ("pearson", "kendall", "spearman"):
        assert own[m, 0] == pytest.approx(1)
        for k in range(1, 5):
            assert own[m, k] == pytest.approx(own[m, -k])
    plain = lagged_correlation(frame(spark, x, y), "x", "y", [2], methods=["spearman"]).first().correlation
    warped = lagged_correlation(frame(spark, np.exp(x), y**3), "x", "y", [2], methods=["spearman"]).first().correlation
    assert plain == pytest.approx(warped)
    whole = lagged_correlation(frame(spark, x, y), "x", "y", [2], methods=["spearman"], window_sizes=[60]).first().correlation
    assert plain == pytest.approx(whole)


def test_constant_empty_and_short(spark):
    flat = lagged_correlation(frame(spark, [1, 1, 1], [1, 2, 3]), "x", "y", [0, 5]).collect()
    assert len(flat) == 6 and all(r.correlation is None for r in flat)
    empty = frame(spark, [1], [1]).limit(0)
    assert lagged_correlation(empty, "x", "y", range(-2, 3)).count() == 15
    with pytest.raises(ValueError):
        lagged_correlation(empty, "x", "y", methods=["cosine"])


def test_keys_do_not_mix(spark):
    a = frame(spark, [1, 2, 3, 4], [1, 2, 3, 4]).selectExpr("'a' AS k", "*")
    b = frame(spark, [1, 2, 3, 4], [4, 3, 2, 1]).selectExpr("'b' AS k", "*")
    got = {(r.k, r.method): r.correlation for r in lagged_correlation(a.union(b), "x", "y", [0], ["k"]).collect()}
    assert all(v == pytest.approx(1 if k == "a" else -1) for (k, _), v in got.items()) and len(got) == 6


def test_extremes_take_the_first_offset(spark):
    rows = [("m", 1, 0.5), ("m", 2, 0.5), ("m", 3, -0.1), ("m", 4, -0.1), ("m", 5, None), ("m", 6, float("nan"))]
    df = spark.createDataFrame(rows, "method string, offset int, correlation double")
    assert tuple(correlation_extremes(df).first()) == ("m", 0.5, 1, -0.1, 3)


def test_pairs_count(spark):
    pairs = lagged_pairs(frame(spark, range(10), range(10)), "x", "y", range(-2, 3))
    assert pairs.count() == 50
    assert pairs.dropna().count() == 10 + 2 * (9 + 8)


def test_every_window_size_with_gaps_and_ties(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 5, 70).astype(float), rng.integers(0, 9, 70).astype(float)
    x[[3, 17, 18, 19, 20, 21]] = np.nan
    y[[0, 40]] = np.nan
    absent = [10, 50, 51, 52, 53, 54, 55, 56, 57, 58, 59]  # places without a row: windows of such only have none either
    df = frame(spark, x, y).where(~F.col("i").isin(absent))
    got = lagged_correlation(df, "x", "y", range(-6, 7, 4), methods=["spearman", "pearson", "kendall"], window_sizes=range(2, 72, 3)).collect()
    kept = [i not in absent for i in range(70)]
    a = pd.Series(x).where(kept)
    want = {
        (w, k // w, m, o)
        for w in range(2, 72, 3)
        for k in range(70)
        if kept[k]
        for m in ("spearman", "pearson", "kendall")
        for o in range(-6, 7, 4)
    }
    assert {(r.window_size, r.window, r.method, r.offset) for r in got} == want and len(got) == len(want)
    for r in got:
        part = slice(r.window * r.window_size, (r.window + 1) * r.window_size)
        value = expected(a[part].to_numpy(), pd.Series(y).where(kept).shift(-r.offset)[part].to_numpy(), 0, r.method)
        assert (r.correlation is None) == (value is None), r
        if value is not None:
            assert r.correlation == pytest.approx(value, abs=1e-12)


def test_ranks_of_many_distinct_values():
    rng = np.random.default_rng(6)
    values = rng.random(40_000)
    values[::7] = values[3]
    both = rng.random(40_000) < 0.9
    got = average_ranks(codes(values), both)
    assert (got[both] == pd.Series(values[both]).rank().to_numpy()).all()
    assert codes(values).dtype == np.int64 and codes(values[:100]).dtype == np.int16


def test_a_series_is_moved_once_and_never_joined(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.range(2000).selectExpr("id % 4 AS k", "id DIV 4 AS i", "rand(1) AS x", "rand(2) AS y").write.parquet(path)
    rows = spark.read.parquet(path)
    for methods, sizes in ((["pearson", "spearman"], None), (["kendall"], None), (["spearman"], range(5, 366))):
        physical = lagged_correlation(rows, "x", "y", keys=["k"], methods=methods, window_sizes=sizes)._jdf.queryExecution().executedPlan().toString()
        assert physical.count("Exchange") == 1 and "Join" not in physical
    blocks = _blocks(list(range(-150, 151)), ["pearson", "spearman", "kendall"], None)
    assert len(blocks) == 9 and sum(len(o) for m, o, _ in blocks if "kendall" in m) == 301


@pytest.mark.parametrize("methods", [["pearson"], ["kendall", "spearman"]])
def test_shares_do_not_change_results(spark, monkeypatch, methods):
    rng = np.random.default_rng(7)
    df = frame(spark, rng.integers(0, 30, 50), rng.random(50))

    def rows(sizes):
        return sorted(map(tuple, lagged_correlation(df, "x", "y", range(-9, 10), methods=methods, window_sizes=sizes).collect()), key=str)

    whole, cut = rows(None), rows([7, 20])
    for name, value in (("TOGETHER", 1), ("SHARE", 5), ("TAU_SHARE", 5)):
        monkeypatch.setattr(correlate, name, value)
    assert [r[:-1] for r in whole] == [r[:-1] for r in rows(None)] and [r[:-1] for r in cut] == [r[:-1] for r in rows([7, 20])]
    for old, new in zip(whole + cut, rows(None) + rows([7, 20])):
        assert old[-1] == pytest.approx(new[-1]) if old[-1] is not None else new[-1] is None
