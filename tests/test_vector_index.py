"""Exact recall from the stored index, whatever it skips."""

import numpy as np
import pytest

from tickloom.operators import vector_index
from tickloom.operators.vector_index import VectorIndex

VECTORS, ASKED = "vec_id long, embedding array<float>", "query_id long, query array<float>"


def clustered(n, groups, dims, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return (centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dims))).astype(np.float32)


def brute(vectors, queries, k):
    unit = lambda x: x.astype(float) / np.linalg.norm(x.astype(float))
    out = {}
    for q, query in queries:
        scores = sorted((-round(float(unit(query) @ unit(v)), 12), i) for i, v in vectors)
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def as_dict(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], -r["score"], r["vec_id"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])


def table(spark, vectors, schema=VECTORS):
    return spark.createDataFrame([(i, v.tolist()) for i, v in vectors], schema)


def test_equals_brute_force_and_skips_most(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 64)
    monkeypatch.setattr(vector_index, "QUERIES", 16)
    vectors = list(enumerate(clustered(3000, 40, 16, 1)))
    vectors += [(5000 + i, vectors[i][1]) for i in range(30)]  # copies
    queries = [(i, v) for i, v in vectors if i % 50 == 0] + [(9000 + i, v) for i, v in enumerate(clustered(10, 40, 16, 9, 1.0))]
    index = VectorIndex.build(table(spark, vectors), f"{tmp_path}/a")
    asked = table(spark, queries, ASKED)
    same(as_dict(index.search(asked, 7)), brute(vectors, queries, 7))
    assert 0 < index.read_share(asked, 7) < 0.4
    # blocks hold so many vectors at most, but for those of equal hashes
    sizes = index.rows().groupBy("list", "block").count().collect()
    assert max(r["count"] for r in sizes) < 2 * 64 and sum(r["count"] for r in sizes) == len(vectors)


def test_reopened_and_extended(spark, tmp_path):
    """Rows added later are found, also far from all centres; the centres stay."""
    first, more = list(enumerate(clustered(300, 5, 8, 2))), [(1000 + i, v) for i, v in enumerate(clustered(200, 3, 8, 3))]
    VectorIndex.build(table(spark, first), f"{tmp_path}/b")
    index = VectorIndex.open(spark, f"{tmp_path}/b")
    index.extend(table(spark, more))
    queries = [first[0], first[1], more[0], more[5]]
    same(as_dict(VectorIndex.open(spark, f"{tmp_path}/b").search(table(spark, queries, ASKED), 12)), brute(first + more, queries, 12))


def test_awkward_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [1e-30, 1e-30]), (8, [-1.0, 0.0]), (9, [None, 1.0]), (None, [1.0, 1.0])]
    index = VectorIndex.build(spark.createDataFrame(rows, VECTORS), f"{tmp_path}/c")
    asked = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], ASKED)
    got = as_dict(index.search(asked, 3))
    assert {q: [i for i, _ in r] for q, r in got.items()} == {1: [1, 2, 7], 4: [7, 1, 2]}
    assert got[1][2][1] == pytest.approx(0.5**0.5)
    empty = VectorIndex.build(spark.createDataFrame([], VECTORS), f"{tmp_path}/d")
    assert empty.search(asked, 3).count() == 0 and empty.read_share(asked) == 0
    assert index.search(asked.limit(0), 3).count() == 0


def test_routes_are_few_and_handed_on_in_pieces(spark, tmp_path, monkeypatch):
    """A query's vector goes once to many blocks, and no task makes all of its routes at once, where nothing can be skipped."""
    monkeypatch.setattr(vector_index, "BLOCK", 4)
    vectors = list(enumerate(np.random.default_rng(4).normal(size=(1500, 64)).astype(np.float32)))
    index = VectorIndex.build(table(spark, vectors), f"{tmp_path}/e")
    kind, routes, large = type(spark.range(0)), spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    mapped = kind.mapInPandas

    def seen(self, func, schema):
        def counted(frames):
            for frame in func(frames):
                routes.add(len(frame))
                large.add(int(len(frame) > 64))
                yield frame

        return mapped(self, counted, schema)

    monkeypatch.setattr(kind, "mapInPandas", seen)
    monkeypatch.setattr(vector_index, "ROUTES", 64, raising=False)
    same(as_dict(index.search(table(spark, vectors[:150], ASKED), 5)), brute(vectors, vectors[:150], 5))
    blocks = index.rows().select("list", "block").distinct().count()
    assert blocks > 300 and routes.value < 150 * 10 and large.value == 0


def test_small_pieces_and_large_groups_of_copies(spark, tmp_path, monkeypatch):
    """Groups of queries that are empty for some bundle, copies that fill many blocks, and more asked for than there is."""
    for name, n in (("BLOCK", 16), ("BUNDLE", 50), ("QUERIES", 2), ("AT_ONCE", 3), ("BOUNDS", 100), ("ROUTES", 2)):
        monkeypatch.setattr(vector_index, name, n)
    drawn = np.random.default_rng(6).normal(size=(150, 6)).astype(np.float32)
    vectors = list(enumerate(drawn)) + [(1000 - i, drawn[7] * (2.0 if i % 2 else 1.0)) for i in range(80)]
    index = VectorIndex.build(table(spark, vectors), f"{tmp_path}/f")
    asked = vectors[:10] + vectors[-1:]
    for k in (3, 300):
        same(as_dict(index.search(table(spark, asked, ASKED), k)), brute(vectors, asked, k))
