import hashlib
import string

from cases import EDGE

from spotframe.llm import exact_dedup, queries

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(d)
    out = []
    for text, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        first = True
        for d in ids:
            kept = d == keep and first
            first = first and not kept
            out.append((d, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[4], r[0] is not None, r[0] or 0, r[3]))


def test_groups_match_brute_force(documents):
    rows = EDGE + [(i, "HOT copy É" if i % 2 else "hot Copy É") for i in range(100, 200)] + [(300, "hot copy é"), (None, "only null")]
    for salt_rows in (20_000, 7):
        got = exact_dedup.exact_groups(documents(rows), salt_rows)
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert order(got.collect()) == order(plain(rows))


def test_salted_groups_stay_small(documents):
    df = documents([(i, "same") for i in range(400)])
    rows = exact_dedup.exact_groups(df, salt_rows=10)
    assert {(r.keep_id, r.group_size) for r in rows.collect()} == {(399, 400)}


def test_drop_copies_keeps_columns(documents):
    df = documents(EDGE)
    got = exact_dedup.drop_copies(df)
    assert got.columns == df.columns
    want = sorted((d or 0, (t or "")) for d, t, k in
                  [(a[0], None, a[3]) for a in plain(EDGE)] if k)
    assert sorted((r.doc_id or 0) for r in got.collect()) == sorted(d for d, _ in want)


def test_empty_table_and_query(llm, documents, tables):
    assert exact_dedup.exact_groups(documents([])).count() == 0
    assert exact_dedup.drop_copies(documents([])).count() == 0
    got = queries.op7_exact_dedup(llm, tables(documents=documents(EDGE)))
    assert order(got.collect()) == order(plain(EDGE))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_drop_keeps_columns_of_clashing_names(llm):
    rows = [(1, "same", "a", "b", "c"), (2, "SAME", "d", "e", "f"), (None, "other", "g", "h", "i")]
    df = llm.createDataFrame(rows, "doc_id int, text string, own_id string, Own_Digest string, digest string")
    got = exact_dedup.drop_copies(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows[1:], key=str)
