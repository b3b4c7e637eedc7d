import numpy as np
import pytest
from pyspark.sql import functions as F

from spotframe.llm import bit_codes, queries

SCHEMA = "vec_id long, embedding array<float>, label int, ids string, rank string"


def plain(rows, wanted, k):
    """All distances, in double precision."""
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = []
    for i, q in rows:
        if wanted(i):
            d = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in rows if j != i)
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(d[:k])]
    return sorted(out)


@pytest.fixture
def embeddings(llm):
    def make(rows):
        return llm.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x", "y") for i, v in rows], SCHEMA)
    return make


def check(got, want, recall=1.0):
    got = sorted(map(tuple, got.collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    hit = {(g[0], g[2]): g[3] for g in got}
    exact = {(w[0], w[2]): w[3] for w in want}
    same = hit.keys() & exact.keys()
    assert len(same) >= recall * len(exact)
    assert all(hit[x] == pytest.approx(exact[x], rel=1e-12, abs=1e-12) for x in same)
    if recall == 1.0:
        assert [g[:3] for g in got] == [w[:3] for w in want]


def test_equals_brute_force(embeddings, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 32)) * 2
    rows = [(i, centres[i % 12] + rng.normal(size=32)) for i in range(1500)]
    want = plain(rows, lambda i: i % 20 == 0, 10)
    check(bit_codes.nearest_neighbours(embeddings(rows).repartition(4), F.col("vec_id") % 20 == 0), want, 0.99)
    # many pivots, blocks, packs and groups of queries
    for name, value in (("PIVOT_ROWS", 200), ("BLOCK", 100), ("PACK", 16), ("GROUP", 32)):
        monkeypatch.setattr(bit_codes, name, value)
    check(bit_codes.nearest_neighbours(embeddings(rows).repartition(4), F.col("vec_id") % 20 == 0), want, 0.99)


def test_copies_ties_and_unusable_vectors(embeddings, monkeypatch):
    monkeypatch.setattr(bit_codes, "BLOCK", 50)
    rng = np.random.default_rng(2)
    hot = rng.normal(size=8)
    rows = [(i, hot if i % 3 else rng.normal(size=8)) for i in range(400)]
    rows += [(7, rows[3][1]), (7, hot), (100, rows[100][1])]
    bad = [(900, None), (1000, [float("nan")] * 8), (1100, [0.0] * 8), (1200, []), (1300, [1.0] * 7), (1400, [None] + [1.0] * 7),
           (None, [1.0] * 8), (1500, [float("inf")] * 8)]
    once = [r for n, r in enumerate(rows) if n != 402]
    want = plain(once, lambda i: i % 100 == 0, 10)
    assert {w[3] for w in want if w[0] == 200} == {0.0}
    check(bit_codes.nearest_neighbours(embeddings(rows + bad), F.col("vec_id") % 100 == 0), want)


def test_few_and_no_rows(llm, embeddings, tables):
    none = bit_codes.nearest_neighbours(embeddings([]), F.col("vec_id") >= 0)
    assert none.count() == 0 and none.columns == ["query_id", "rank", "vec_id", "score"]
    assert bit_codes.nearest_neighbours(embeddings([(1, [1.0, 2.0])]), F.col("vec_id") >= 0).count() == 0
    rows = [(0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [1.0, 2.0]), (100, [5.0, 5.0])]
    got = queries.op13_bit_codes(llm, tables(embeddings=embeddings(rows)))
    check(got, plain(rows, lambda i: i % 100 == 0, 10))


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(4000, 64)), rng.normal(size=(50, 64))
    coder = bit_codes.Coder.of(x[:500], 1)
    codes, reach, agree = coder.encode(x, 0)
    assert codes.shape == (4000, 4) and 0.75 < agree.mean() < 0.85
    block = bit_codes.Block(coder, 0, np.arange(4000), x, codes, reach, agree)
    off = q - coder.pivots[0]
    for j, (guess, slack) in enumerate(block.estimates(off @ coder.rotation, np.sqrt((off ** 2).sum(1)))):
        true = ((x - q[j]) ** 2).sum(1)
        assert (true >= guess - slack).mean() > 0.999
        assert abs((guess - true).mean()) < 0.05 * true.mean()
    list(block.nearest(np.full(50, -1), q, np.full(50, np.inf), 10))
    assert block.compared < 0.5 * 50 * 4000
