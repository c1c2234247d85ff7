import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronlens.llm import mtree
from patronlens.llm.queries import op11_top_k

VECTORS = "vec_id long, embedding array<float>"


def brute(rows, asks, k):
    """All products, in whole numbers."""
    kept = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.setdefault((i, tuple(math.floor(64 * float(np.float32(x))) for x in v)))
    width = max((len(v) for _, v in kept), default=0)
    pad = lambda v: v + (0,) * (width - len(v))
    held = sorted({(i, pad(v)) for i, v in kept})
    greatest = {}
    for i, v in kept:
        if asks(i):
            greatest[i] = max(greatest.get(i, v), v)
    out = []
    for q, v in greatest.items():
        v = pad(v)
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in held if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(spark, rows, condition="vec_id % 20 = 0", k=20, clash=False):
    df = spark.createDataFrame(rows, VECTORS)
    if clash:
        df = df.select("*", *[F.lit("x").alias(c) for c in ("id", "v", "route", "tile", "query", "score", "rank", "label")])
    return sorted(tuple(r[c] for c in ("query_id", "rank", "id", "score")) for r in mtree.top_k(df, df.where(condition), k=k).collect())


def gaussian(n, width=12, seed=0, centres=1):
    r = np.random.default_rng(seed)
    middle = 4 * r.normal(size=(centres, width))
    return [(i, [float(x) for x in (middle[i % centres] + r.normal(size=width)).astype(np.float32)]) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    """Many routes, tiles, pages and groups of queries on few rows."""
    for name, value in (("PAGE", 5), ("TREE_ROWS", 60), ("QUERY_GROUP", 20), ("QUERY_BLOCK", 7), ("MOST_ROUTES", 6)):
        monkeypatch.setattr(mtree, name, value)


def test_many_tiles(spark, small):
    rows = gaussian(900, centres=4)
    assert found(spark, rows) == brute(rows, lambda i: i % 20 == 0, 20)


def test_one_page(spark):
    rows = gaussian(30)
    assert found(spark, rows, k=3) == brute(rows, lambda i: i % 20 == 0, 3)


def test_fewer_rows_than_k(spark):
    rows = gaussian(12)
    assert found(spark, rows) == brute(rows, lambda i: i % 20 == 0, 20)
    assert found(spark, rows[:1]) == []


def test_ties_and_equal_vectors(spark, small):
    """A third of the rows are one vector; a rounded grid makes equal products; the smallest ids win."""
    r = np.random.default_rng(3)
    rows = [(i, [1.0, 0.5, 0.25]) if i % 3 == 0 else (i, [float(x) / 8 for x in r.integers(-2, 3, 3)]) for i in range(700)]
    assert found(spark, rows) == brute(rows, lambda i: i % 20 == 0, 20)
    same = [(i, [0.5, 0.5]) for i in range(200)]
    assert found(spark, same) == brute(same, lambda i: i % 20 == 0, 20)


def test_odd_rows(spark, small):
    """Nulls, NaN, infinities, short and empty vectors, repeated rows, one id with two vectors, negative ids, clashing columns."""
    rows = gaussian(100, width=4)
    rows += rows[::5] + [(20, [9.0, 9.0, 9.0, 9.0]), (20, [-9.0, 9.0, 9.0, 9.0]), (-20, [1.0, 2.0, 3.0, 4.0]), (None, [5.0] * 4), (200, None)]
    rows += [(220, []), (221, [2.0]), (240, [1.0, None, 1.0, 1.0]), (241, [float("nan")] * 4), (260, [float("inf"), 1.0, 1.0, 1.0])]
    assert found(spark, rows, clash=True) == brute(rows, lambda i: i % 20 == 0, 20)


def test_zero_vectors_and_wide_numbers(spark):
    rows = [(i, [0.0, 0.0]) for i in range(30)] + [(i, [float(i) * 1e4, -float(i) * 3e5]) for i in range(30, 70)]
    assert found(spark, rows) == brute(rows, lambda i: i % 20 == 0, 20)


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, [None])]) == []
    assert found(spark, gaussian(9)[1:], condition="vec_id < 0") == []


def test_queries_may_be_another_table(spark):
    held, asking = gaussian(200, seed=1), [(1000 + i, v) for i, v in gaussian(10, seed=2)]
    got = mtree.top_k(spark.createDataFrame(held, VECTORS), spark.createDataFrame(asking, VECTORS), k=4)
    expected = brute(held + asking, lambda i: i >= 1000, 100)
    expected = [r for q in range(1000, 1010) for r in [x for x in expected if x[0] == q and x[2] < 1000][:4]]
    assert sorted((r["query_id"], r["id"], r["score"]) for r in got.collect()) == sorted((q, i, s) for q, _, i, s in expected)


def loaded(rows):
    loader = mtree.Loader(np.arange(len(rows)), rows)
    loader.load(np.arange(len(rows)))
    return loader


def test_pages_hold_what_they_say(small):
    """Every row once; radii cover all that lies below; distances from the parent are as stored."""
    rows = np.array([[math.floor(64 * x) for x in v] for _, v in gaussian(400, centres=3)])
    loader = loaded(rows)
    seen = []

    def below(number):
        inner, entries, radii, _, links = loader.pages[number]
        if not inner:
            seen.extend(links.tolist())
            return links
        all_below = []
        for entry, radius, child in zip(entries, radii, links.tolist()):
            under = below(child)
            assert (loader.distances(under, np.array([entry]))[:, 0] <= radius + 1e-6).all()
            stored = loader.pages[child][3]
            assert np.allclose(stored, loader.distances(loader.pages[child][1], np.array([entry]))[:, 0])
            all_below.append(under)
        return np.concatenate(all_below)

    below(len(loader.pages) - 1)
    assert sorted(seen) == list(range(400)) and max(len(p[4]) for p in loader.pages) <= 5


def test_bounds_spare_computations(monkeypatch):
    """On grouped unit vectors most products are never computed, and the answer is the same."""
    r = np.random.default_rng(0)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = np.floor(64 * unit(unit(r.normal(size=(40, 16)))[np.arange(4000) % 40] + 0.05 * r.normal(size=(4000, 16)))).astype(int)
    loader = loaded(rows)
    pages = [mtree.Page(i, mtree.pack(rows[e]).tobytes(), d.tobytes(), p.tobytes(), n.tobytes(), 16) for i, e, d, p, n in loader.pages]
    done, plain = [0], mtree.products
    monkeypatch.setattr(mtree, "products", lambda a, b: done.__setitem__(0, done[0] + len(a) * len(b)) or plain(a, b))
    asks = np.arange(7, 4000, 40)  # of one group, as queries of one route are
    none = np.full(len(asks), mtree.NONE), np.full(len(asks), mtree.LAST)
    best = mtree.search_tree(pages, loader.top, asks, rows[asks], *none, 10)
    for q, ids, scores in zip(asks, best.ids, best.scores):
        expected = sorted((-int(rows[q] @ rows[i]), i) for i in range(4000) if i != q)[:10]
        assert list(zip(ids.tolist(), scores.tolist())) == [(i, -s) for s, i in expected]
    assert done[0] < 0.3 * len(asks) * 4000


def test_registered_query(spark, folder):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in op11_top_k(spark, folder).collect())
    assert got == brute(rows, lambda i: i % 20 == 0, 20)
