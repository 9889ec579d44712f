"""Links and components against all pairs."""

import math

import numpy as np
import pytest

from mediaseries.llm import embedding_dedup as module
from mediaseries.llm.embedding_dedup import link_vectors, spherical_kmeans, unit

SCHEMA = "vec_id long, embedding array<float>, label int, extra string"


def plain(rows):
    """n_links and component of each vector from all pairs."""
    sound = {}
    for i, vector, label, _ in rows:
        if label is not None and vector and None not in vector:
            x = np.array(vector, np.float32).astype(np.float64)
            if np.isfinite(x).all() and x.any():
                sound[i] = (label, x)
    links = {i: set() for i, *_ in rows}
    ids = sorted(sound)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            (a, x), (b, y) = sound[i], sound[j]
            if a == b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links[i].add(j)
                links[j].add(i)
    low = {i: i for i in links}
    while True:
        new = {i: min([low[i], *(low[j] for j in links[i])]) for i in links}
        if new == low:
            return {i: (len(links[i]), low[i]) for i in links}
        low = new


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(60):
        base = rng.normal(size=8)
        label = int(rng.integers(3))
        for _ in range(rng.integers(1, 7)):
            rows.append((len(rows), (base + rng.normal(size=8) * rng.choice([0, 0.05, 0.12, 0.25])).tolist(), label, "x"))
    n = len(rows)
    rows += [(n, None, 1, "x"), (n + 1, [], 1, "x"), (n + 2, [0.0] * 8, 1, "x"), (n + 3, rows[0][1], None, "x"), (n + 4, [math.nan] * 8, 1, "x")]
    rows += [(n + 5, [math.inf] + [1.0] * 7, 1, "x"), (n + 6, [None] + [1.0] * 7, 1, "x"), (n + 7, [1.0] * 3, 1, "x"), (n + 8, [2.0] * 3, 1, None)]
    rows += [(n + 9 + k, [float(v) * 3 for v in rows[5][1]], rows[5][2], "x") for k in range(5)]
    return rows


@pytest.mark.parametrize("cell_rows, block", [(4096, 2048), (20, 7)])
def test_against_all_pairs(spark, monkeypatch, cell_rows, block):
    monkeypatch.setattr(module, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(module, "BLOCK", block)
    rows = vectors(3)
    got = link_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == plain(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_repeated_rows_and_null_ids(spark):
    rows = [(4, [1.0, 0.0], 1, "x"), (4, [1.0, 0.0], 1, "x"), (None, [1.0, 0.01], 1, "x"), (7, [0.0, 1.0], 1, "x")]
    got = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"]) for r in link_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(False, 4, 2), (False, 4, 2), (False, 7, 0), (True, 0, 2)]
    assert link_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_centroids_are_unit_vectors():
    x = unit(np.random.default_rng(1).normal(size=(200, 5)))
    c = spherical_kmeans(x, 9)
    assert c.shape == (9, 5) and np.allclose(np.linalg.norm(c, axis=1), 1)
