import numpy as np
import pytest
from pyspark.sql import functions as F

from stationspark.llm import graph, vectors


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 12))
    x[60:120] = x[:60] + rng.normal(size=(60, 12)) * 0.2
    x[120:150] = x[0]
    rows = [(int(k), [float(np.float32(v)) for v in r], 1) for k, r in enumerate(x)]
    rows += [(500, None, 1), (501, [1.0, None] + [0.0] * 10, 1), (502, [float("nan")] * 12, 1), (503, [0.0] * 12, 1), (504, [float("inf")] + [0.0] * 11, 1), (505, [-0.0] * 12, 1), (None, [1.0] * 12, 1), (520, [1.0, 2.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")


def usable(table):
    rows = [(r.vec_id, r.embedding) for r in table.collect() if r.vec_id is not None and r.embedding and all(v is not None and np.isfinite(v) for v in r.embedding)]
    return np.array([r[0] for r in rows]), np.array([list(r[1]) + [0.0] * (12 - len(r[1])) for r in rows])


@pytest.mark.parametrize("shard, block", [(8192, 2048), (17, 5)])
def test_top_k_is_brute_force(table, monkeypatch, shard, block):
    monkeypatch.setattr(vectors, "SHARD", shard)
    monkeypatch.setattr(vectors, "BLOCK", block)
    ids, x = usable(table)
    z = np.floor(64 * x).astype(int)
    expected = set()
    for q in np.flatnonzero(ids % 20 == 0):
        score = z @ z[q]
        best = [j for j in np.lexsort((ids, -score)) if j != q][:7]
        expected |= {(int(ids[q]), k + 1, int(ids[j]), int(score[j])) for k, j in enumerate(best)}
    assert {tuple(r) for r in vectors.top_k(table, F.col("vec_id") % 20 == 0, 7).collect()} == expected


def test_repeated_queries_have_one_whole_result(spark):
    rng = np.random.default_rng(9)
    rows = [(int(k), [float(v) for v in rng.integers(-3, 3, 4)]) for k in range(60)]
    rows += [(20, rows[20][1]), (20, rows[20][1]), (40, [9.0, 9.0, 9.0, 9.0]), (31, rows[31][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in vectors.top_k(df, F.col("vec_id") % 20 == 0, 20, scale=1).collect()]
    for q in (0, 20, 40):
        x = min(v for k, v in rows if k == q)
        best = sorted((-int(np.dot(x, v)), k) for k, v in rows if k != q)[:20]
        assert sorted(r[1:] for r in got if r[0] == q) == [(n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert len(got) == 60


def test_max_score_prunes_and_keeps_ties():
    rng = np.random.default_rng(2)
    docs, queries = rng.integers(-40, 40, (9000, 40)), rng.integers(-40, 40, (30, 40))
    docs[::3] = docs[0]
    docs[:, 5:] //= 8
    ids, own = np.arange(9000) * 2, np.arange(30) * 20
    q, i, s = vectors.max_score(ids, docs, own, queries, 20)
    for k in range(30):
        score = docs @ queries[k]
        best = [j for j in np.lexsort((ids, -score)) if ids[j] != own[k]][:20]
        assert [(int(a), int(b)) for a, b in zip(i[q == k], s[q == k], strict=True)] == [(int(ids[j]), int(score[j])) for j in best]


@pytest.mark.parametrize("tile", [4096, 40])
def test_near_duplicates_are_brute_force(table, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    ids, x = usable(table)
    norm = np.linalg.norm(x, axis=1)
    cosine = x @ x.T / np.outer(np.where(norm == 0, 1, norm), np.where(norm == 0, 1, norm))
    hit = (cosine >= 0.9) & (norm[:, None] > 0) & (norm[None, :] > 0)
    np.fill_diagonal(hit, False)
    label = ids.copy()
    for _ in range(len(ids)):
        label = np.minimum(label, np.where(hit, label[None, :], 10**9).min(axis=1))
    rows = {r.vec_id: r for r in vectors.near_duplicates(table).collect()}
    assert len(rows) == table.count()
    for k, i in enumerate(ids):
        r = rows[int(i)]
        assert (r.n_links, r.component_id, r.kept) == (int(hit[k].sum()), int(label[k]), bool(label[k] == i))
    for i in (500, 501, 502, 503, 504, 505):
        assert (rows[i].n_links, rows[i].component_id, rows[i].kept) == (0, i, True)


@pytest.mark.parametrize("group", [1, 8 << 20])
def test_ranges_leave_out_far_tiles(spark, monkeypatch, group):
    monkeypatch.setattr(vectors, "TILE", 25)
    monkeypatch.setattr(vectors, "GROUP", group)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    x = np.repeat(centres, 30, axis=0) + rng.normal(size=(360, 8)) * rng.choice([0.05, 0.3], size=(360, 1))
    x[0], x[1], x[2] = x[0] * 1e200, x[0] * 1e190, x[0] * 1e-300
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    met = []
    found = vectors.reachable
    monkeypatch.setattr(vectors, "reachable", lambda *a: met.append(found(*a)) or met[0])
    rows = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    label = np.arange(360)
    for _ in range(20):
        label = np.minimum(label, np.where(hit, label[None, :], 999).min(axis=1))
    assert [(rows[k].n_links, rows[k].component_id) for k in range(360)] == [(int(hit[k].sum()), int(label[k])) for k in range(360)]
    assert hit[0, 1] and 0.1 < met[0].mean() < 0.7


def test_copies_and_empty(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in (7, 3, 9, 3)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, vectors.near_duplicates(same).collect())) == [(3, 3, 3, True), (3, 3, 3, True), (7, 3, 3, False), (9, 3, 3, False)]
    none = same.limit(0)
    assert vectors.near_duplicates(none).count() == 0 and vectors.top_k(none, F.lit(True)).count() == 0


@pytest.mark.parametrize("chunk", [1 << 16, 10])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(graph, "CHUNK", chunk)
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 299), (299, 300)]
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{k: 0 for k in range(31)}, **{k: 100 for k in range(100, 160)}, 299: 299, 300: 299}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
