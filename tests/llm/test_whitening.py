import math

import numpy as np
import pytest

from spotframe.llm import bidiagonal, queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, component string"


def plain(vectors):
    """(n, deviations, whitened, explained) by exact sums and a dense eigen-solver."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    off = [[n * r[j] - s[j] for j in range(d)] for r in x]
    centred = np.array([[o / n for o in r] for r in off])
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    return n, [sum(o * o for o in r) for r in off], centred @ vector / np.sqrt(np.maximum(value, 1e-300)), value / value.sum()


@pytest.fixture
def embeddings(llm):
    def make(rows):
        return llm.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x", "y") for i, v in rows], SCHEMA)
    return make


def check(got, vectors, components):
    n, deviation, white, share = plain(vectors)
    table = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(table) == n * components
    for k in range(components):
        mine = np.array([table[i, k + 1].whitened for i in range(n)])
        sign = np.sign(mine @ white[:, k])
        assert np.allclose(sign * mine, white[:, k], atol=1e-8)
        assert all(table[i, k + 1].explained == pytest.approx(share[k], rel=1e-9) for i in range(n))
    assert [table[i, 1].deviation for i in range(n)] == deviation
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9


def test_equals_dense_solver(embeddings):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 40)) * np.linspace(0.1, 2, 40) + 3).astype(np.float32)
    bad = [(1000, None), (1001, [1.0] * 39 + [float("nan")]), (1002, [1.0] * 39 + [float("inf")]), (1003, [1.0] * 39 + [None]),
           (1004, []), (1005, [1.0, 2.0]), (1006, [1e30] * 40)]
    df = embeddings([*enumerate(vectors), *bad])
    check(whitening.whiten(df.repartition(5)).collect(), vectors, 32)


def test_tree_of_many_tasks_and_repeats(embeddings, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 4)
    rng = np.random.default_rng(2)
    vectors = np.repeat(rng.normal(size=(30, 5)).astype(np.float32), 3, axis=0)
    check(whitening.whiten(embeddings(list(enumerate(vectors))).repartition(9)).collect(), vectors, 5)


def test_components_without_variance(embeddings):
    rng = np.random.default_rng(3)
    vectors = np.hstack([rng.normal(size=(50, 3)), np.full((50, 2), 0.25)])
    got = whitening.whiten(embeddings(list(enumerate(vectors)))).collect()
    flat = {r.component: (r.whitened, r.explained) for r in got}
    assert flat[4] == flat[5] == (None, 0.0) and flat[3][0] is not None
    assert got[0].identity_error < 1e-9
    one = whitening.whiten(embeddings([(None, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.whitened, r.deviation, r.identity_error) for r in one] == [(None, None, 0, None)] * 2


def test_exact_deviation_beyond_machine_words():
    centre = whitening.Centre(3, [10, 2 ** 62])
    x = np.array([[4, 2 ** 60], [3, 1]], np.int64)
    want = [(3 * 4 - 10) ** 2 + (3 * 2 ** 60 - 2 ** 62) ** 2, (9 - 10) ** 2 + (3 - 2 ** 62) ** 2]
    assert centre.deviations(x) == [w if w < 2 ** 63 else None for w in want]


def test_empty_table_and_query(llm, embeddings, tables):
    assert whitening.whiten(embeddings([(1, None)])).count() == 0
    assert whitening.whiten(embeddings([])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    vectors = np.random.default_rng(4).normal(size=(60, 8)).astype(np.float32)
    check(queries.op11_whitening(llm, tables(embeddings=embeddings(list(enumerate(vectors))))).collect(), vectors, 8)


def _check_solver(r):
    value, vector = bidiagonal.right_singular(r)
    want = np.linalg.svd(r, compute_uv=False)
    n, top = len(r), max(want.max(), 1e-300)
    assert np.abs(np.sqrt(np.maximum(value, 0)) - want).max() <= 1e-13 * top
    assert np.abs(vector.T @ vector - np.eye(n)).max() < 1e-8
    assert np.abs(r.T @ (r @ vector) - vector * value).max() <= 1e-8 * top ** 2


def test_solver_on_graded_clustered_and_singular_matrices():
    rng = np.random.default_rng(5)
    turn = lambda n: np.linalg.qr(rng.normal(size=(n, n)))[0]
    wilkinson = np.diag(np.abs(np.arange(-10.0, 11)) + 12) + np.eye(21, k=1) + np.eye(21, k=-1)
    glued = np.kron(np.eye(3), wilkinson)
    for i in (20, 41):
        glued[i, i + 1] = glued[i + 1, i] = 1e-8
    spread = [np.r_[np.ones(20), 2 + 1e-9 * np.arange(20), np.linspace(3, 4, 24)], np.r_[np.ones(32), 2 * np.ones(32)],
              10.0 ** -np.arange(64), np.r_[np.ones(5), np.zeros(59)]]
    for r in [np.eye(9), np.zeros((4, 4)), np.array([[3.0]]), np.linalg.cholesky(glued).T, wilkinson, *(turn(64) * s @ turn(64) for s in spread)]:
        _check_solver(r)
    for _ in range(100):
        n = int(rng.integers(1, 40))
        _check_solver(np.linalg.qr(rng.normal(size=(50, n)) * 10.0 ** rng.integers(-3, 4, n), mode="r"))


def test_dqds_keeps_small_values_to_their_own_digits():
    a, b = 10.0 ** -np.arange(0, 24, 3.0), 10.0 ** -np.arange(1, 22, 3.0)
    got = bidiagonal.dqds(a, b)
    assert math.prod(got) == pytest.approx(math.prod(x * x for x in a), rel=1e-12)
    assert all(x > 0 for x in got) and got == sorted(got, reverse=True)
