import re
from itertools import permutations

import duckdb
import numpy as np
import pytest
from cases import EDGE
from hypothesis import given, settings
from hypothesis import strategies as st

from spotframe.llm import filter_audit, queries

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LABELS = "doc_id long, quality int, toxic int, part string"
RICH = " ".join(f"word{i}" for i in range(220))
TEXTS = [RICH, RICH, "few words", "SHOUTING " * 250, RICH + " a | b", "same " * 300, RICH.upper(), "", None, "É ÀB", "tab\x0bvt\x1cfs " * 120,
         RICH + " more", "few words"]


def plain(docs, labels):
    """Every order walked over every document."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    parts = {}
    for i, t, lang in docs:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 re.search(r"[#$%&*|]", t) is not None, i is not None and t in least and i > least[t]]
        parts.setdefault(lang or "", []).append((fails, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for k, letter in enumerate(order):
                f = "ABCDE".index(letter)
                lost = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                out[part, "".join(order), k + 1] = [len(left), len(lost), sum(r[0][f] for r in rows) - len(lost),
                                                    sum(r[0][f] and sum(r[0]) == 1 for r in rows), sum(r[1] for r in lost), sum(r[2] for r in lost), letter]
                shapley[letter] += len(lost)
        for (p, _, _), row in out.items():
            if p == part:
                row[-1] = shapley[row[-1]]
    return sorted((*key, *row) for key, row in out.items())


@pytest.fixture
def labels(llm):
    return lambda rows: llm.createDataFrame([(*r, "x") for r in rows], LABELS)


def _docs(llm, rows):
    return llm.createDataFrame([(*r, "a", "b", 1) for r in rows], "doc_id long, text string, lang string, digest string, good string, salt int")


def _sorted(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


ROWS = [(i * 3 % 97, TEXTS[i % len(TEXTS)], [None, "en", "de"][i % 3]) for i in range(90)] + [(i, t, "edge") for i, t in EDGE]
MARKS = [(i, i % 2, i % 5 == 0) for i in range(0, 60)] + [(3, 0, 1), (None, 1, 1), (7, None, None), (4, 0, 0), (4, 1, 0)]
MARKS = [(i, q, None if x is None else int(x)) for i, q, x in MARKS]


def test_every_order_equals_a_walk_over_the_documents(llm, labels, monkeypatch):
    got = _sorted(filter_audit.audit(_docs(llm, ROWS).repartition(3), labels(MARKS)))
    assert got == plain(ROWS, MARKS) and len(got) == 4 * 600
    monkeypatch.setattr(filter_audit, "BLOCK", 8)
    assert _sorted(filter_audit.audit(_docs(llm, ROWS), labels(MARKS))) == got


def test_copies_repeated_ids_and_rows_without_id(llm, labels):
    rows = [(i, "hot copy", "en") for i in range(300)] + [(5, "hot copy", "en"), (5, "other", "de"), (None, "hot copy", "en"), (None, None, "fr")] * 3
    assert _sorted(filter_audit.audit(_docs(llm, rows), labels([(5, 1, 1)]))) == plain(rows, [(5, 1, 1)])


def test_empty_tables(llm, labels):
    assert filter_audit.audit(_docs(llm, []), labels(MARKS)).count() == 0
    rows = [(1, RICH, "en")]
    assert _sorted(filter_audit.audit(_docs(llm, rows), labels([]))) == plain(rows, [])


def test_query_equals_its_sql(llm, labels, tables):
    rows = [r for r in ROWS if r[1] is None or "\x1c" not in r[1]]
    folder = tables(documents=_docs(llm, rows), labels=labels(MARKS))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    sql = con.execute(queries.OP12_SQL)
    names = [c[0] for c in sql.description]
    want = sorted(tuple(r[names.index(c)] for c in COLUMNS) for r in sql.fetchall())
    assert _sorted(queries.op12_filter_audit(llm, folder)) == want == plain(rows, MARKS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 300)), min_size=1, max_size=5), st.integers(1, 40))
def test_merges(sets, stride):
    lists = [np.array(sorted(s), np.int64) for s in sets]
    old, filter_audit.STRIDE = filter_audit.STRIDE, stride
    try:
        assert filter_audit.union(lists).tolist() == sorted(set().union(*sets))
        assert filter_audit.difference(lists[0], lists[1:]).tolist() == sorted(sets[0].difference(*sets[1:]))
        assert filter_audit.shared(lists[0], lists[-1]) == len(sets[0] & sets[-1])
        for bound in (-1, 0, 150, 301):
            assert filter_audit.gallop(lists[0], 0, bound) == sum(x <= bound for x in sets[0])
    finally:
        filter_audit.STRIDE = old
