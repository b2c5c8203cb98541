"""Vector queries against brute force over every pair."""

from __future__ import annotations

import numpy as np
import pytest

from tracelode.queries import vectors as Q


def folder_of(spark, path, vectors, labels, first=0):
    rows = [(first + i, int(c), [float(x) for x in v]) for i, (v, c) in enumerate(zip(vectors, labels))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def drawn():
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(600, 16)).astype("float32")
    return v, rnd.integers(0, 10, 600)


def test_ivf_probe_finds_the_true_best(spark, tmp_path, drawn):
    v, labels = drawn
    got = {(r["query_id"], r["vec_id"]) for r in Q.vec_ivf_probe(spark, folder_of(spark, tmp_path, v, labels)).collect()}
    scores = v.astype(float) @ v.astype(float).T
    np.fill_diagonal(scores, -np.inf)
    want = {(q, int(i)) for q in range(0, 600, 50) for i in np.argsort(-scores[q])[:5]}
    assert got == want


def test_boost_lifts_rows_beyond_the_nearest_200(spark, tmp_path):
    """260 rows of cosine 0.9 without a boost stand before 30 that the boost lifts, 25 of them to the cap."""
    at = lambda cos, side: [cos, *(np.sqrt(1 - cos * cos) * side)]
    rnd = np.random.default_rng(4)
    sides = rnd.normal(size=(291, 8))
    sides /= np.linalg.norm(sides, axis=1, keepdims=True)
    cosines = [0.72 + 0.001 * i for i in range(25)] + [0.65] * 5 + [0.9] * 260
    vectors = [at(1.0, sides[0] * 0)] + [at(c, s) for c, s in zip(cosines, sides)]
    labels = [5] + [0] * 30 + [5] * 260
    folder = folder_of(spark, tmp_path, vectors, labels)
    got = [(r["vec_id"], r["boosted"]) for r in Q.vec_threshold_boost(spark, folder).where("query_id = 0").collect()]
    assert sorted(got) == [(i, 1.0) for i in range(1, 21)]


def test_rare_label_keeps_its_two_best(spark, tmp_path, drawn):
    v, labels = drawn[0].astype(float), drawn[1] % 3
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    rare = np.argsort(unit @ unit[0])[:3]  # the three farthest rows from query 0
    labels = labels.copy()
    labels[rare] = 9
    got = {(r["query_id"], r["label"], r["vec_id"], r["rank"]) for r in Q.vec_topk_per_label(spark, folder_of(spark, tmp_path, unit, labels)).collect()}
    scores = np.round(unit.astype("float32").astype(float) @ unit.astype("float32").astype(float).T, 6)
    want = set()
    for q in range(0, 600, 50):
        for label in (0, 1, 2, 9):
            own = [i for i in np.flatnonzero(labels == label) if i != q]
            want |= {(q, label, int(i), n) for n, i in enumerate(sorted(own, key=lambda i: (-scores[q][i], i))[:2], 1)}
    assert got == want


def test_probe_ranks_by_the_rounded_score(spark, tmp_path):
    """Scores that are equal to six digits go by id, over the rows of every label."""
    vectors = np.array([[1.0, 0.0]] + [[0.5 + i * 6e-8, 0.1] for i in range(7)])
    got = [(r["vec_id"], r["rank"], r["score"]) for r in Q.vec_ivf_probe(spark, folder_of(spark, tmp_path, vectors, np.arange(8))).collect()]
    assert sorted(got) == [(1, 1, 0.5), (2, 2, 0.5), (3, 3, 0.5), (4, 4, 0.5), (5, 5, 0.5)]
