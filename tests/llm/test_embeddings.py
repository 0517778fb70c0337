import math

import numpy as np
import pytest
from helpers import SF, groups

from tickloom.llm import embeddings


def brute(rows, threshold=0.9):
    """{row number: (links, component)} by comparing all pairs."""
    def good(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    usable = [n for n, (_, v) in enumerate(rows) if good(v)]
    size = max({len(rows[n][1]) for n in usable}, key=[len(rows[n][1]) for n in usable].count, default=0)
    usable = [n for n in usable if len(rows[n][1]) == size]
    x = np.array([rows[n][1] for n in usable], np.float64).reshape(len(usable), -1)
    x /= np.linalg.norm(x, axis=1, keepdims=True) if len(x) else 1
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    part = groups(range(len(rows)), [(usable[i], usable[j]) for i, j in np.argwhere(near)])
    links = {usable[i]: int(c) for i, c in enumerate(near.sum(1))}
    members = {}
    for n, p in part.items():
        members.setdefault(p, []).append(rows[n][0])
    return [(rows[n][0], links.get(n, 0), min(members[part[n]])) for n in range(len(rows))]


def test_equals_all_pairs(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = embeddings.near_duplicates(table).collect()
    want = brute([(r["vec_id"], [float(x) for x in r["embedding"]]) for r in table.collect()])
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_many_lists_and_a_large_group(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(700, 16))
    near = base[0] + rng.normal(size=(300, 16)) * 0.08
    copies = np.repeat(base[1:2], 200, axis=0)
    rows = [(n, v.tolist()) for n, v in enumerate(np.concatenate([base, near, copies]))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(table).collect())
    assert got == sorted(brute(rows))


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [1.0, 0.01], None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0, 0.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1e300, 1e298], [-0.0, 2.0]]
    rows = list(enumerate(vectors))
    table = spark.createDataFrame([(n, v, "x", 1) for n, v in rows], "vec_id long, embedding array<double>, node string, list int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(table).collect()}
    alone = {n: (0, n, True) for n in (2, 3, 4, 5, 6, 7, 8)}
    group = {0: (3, 0, True), 1: (3, 0, False), 10: (3, 0, False), 11: (3, 0, False)}
    assert got == alone | group | {9: (1, 9, True), 12: (1, 9, False)}


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("cosine", [0.9, 0.8999])
def test_threshold_is_inclusive(spark, cosine):
    a, b = [1.0, 0.0], [cosine + (1e-12 if cosine == 0.9 else 0), math.sqrt(1 - cosine**2)]
    table = spark.createDataFrame([(1, a), (2, b)], "vec_id long, embedding array<double>")
    assert [r["n_links"] for r in embeddings.near_duplicates(table).collect()] == [int(cosine == 0.9)] * 2


@pytest.mark.parametrize(("dimension", "real", "cosine"), [(64, 64, 0.9), (64, 8, 0.9), (256, 24, 0.9), (768, 24, 0.92)])
def test_recall_of_correlated_vectors_with_many_lists(dimension, real, cosine):
    """Planted pairs at and above a cosine; the exact distance bound of the search loses none of those that are probed."""
    rng = np.random.default_rng(11)
    low = lambda n: rng.normal(size=(n, real))
    one = low(1000)
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    step = low(1000)
    step -= (step * one).sum(1, keepdims=True) * one
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    c = rng.uniform(cosine, cosine + 0.03, size=(1000, 1))
    x = np.concatenate([low(28_000), one, c * one + np.sqrt(1 - c**2) * step]) @ np.linalg.qr(rng.normal(size=(dimension, real)))[0].T
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert ((x[-2000:-1000] * x[-1000:]).sum(1) >= cosine - 1e-9).all()
    lists = len(x) // embeddings.LIST
    q = embeddings.Quantiser.fit(x[:: max(1, len(x) // min(lists * embeddings.PER_LIST, embeddings.SAMPLE_FLOATS // dimension))], lists)
    own = q.encode(x[-2000:])[0]
    row, at = q.probes(x[-2000:], math.sqrt(0.2))
    asked = set(zip(row.tolist(), at.tolist(), strict=True))
    recall = np.mean([(n, own[n + 1000]) in asked or (n + 1000, own[n]) in asked for n in range(1000)])
    print(f"{dimension}-d, {real} real, {lists} lists: recall {recall:.3f}, {len(row) / 2000:.1f} lists a vector")
    assert lists > 100 and recall >= 0.98


def test_every_length_is_searched(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    rng = np.random.default_rng(3)
    sets = {}
    for size, n in ((8, 300), (5, 100), (3, 20), (2, 1)):
        base = rng.normal(size=(n, size))
        sets[size] = np.concatenate([base, base[: n // 2] + rng.normal(size=(n // 2, size)) * 0.05, base[:2]]).tolist()
    mixed = [v for k in range(500) for s in sets.values() for v in s[k : k + 1]]
    rows = list(enumerate(mixed))
    want = []
    for size in sets:
        mine = [(n, v) for n, v in rows if len(v) == size]
        want += brute(mine)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == sorted(want) and {len(mixed[i]) for i, n, _ in got if n} == {8, 5, 3, 2}
