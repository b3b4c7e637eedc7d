import hashlib
import re

from cases import EDGE

from spotframe.llm import queries, spotsigs
from spotframe.llm.common import text_of

WORDS = "the ship of stone and a lamp in rain is the old tower on green hills for every sailor that waits by night"


def chains(text, chain=3):
    """Spots as tuples of words, by a plain walk."""
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    anchors = set(spotsigs.ANCHORS)
    units, pending = [], []
    for i, w in enumerate(words):
        if w in anchors and i + 1 < len(words):
            pending.append(w)
        else:
            units.append((pending, w))
            pending = []
    found = [tuple(w for _, w in units[i:i + chain]) for i in range(len(units))]
    own = {(a, *f) for (run, _), f in zip(units, found) for a in run}
    return own or {(None, *f) for f in found}


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def rows_with_prose():
    words = WORDS.split()
    return EDGE + [(100 + k, " ".join(words[k:] + words[:k])) for k in range(12)] + [(200, "the"), (201, "of the and"), (202, "cat dog")]


def test_spots_are_the_chains_after_anchors(documents):
    rows = rows_with_prose()
    got = documents(rows).select("doc_id", "text", spotsigs.spots(text_of()).alias("s")).collect()
    for r in got:
        assert len(r.s) == len(chains(r.text or "")), r.text
        assert list(r.s) == sorted(set(r.s))


def test_op2_query(llm, documents, tables):
    rows = rows_with_prose()
    got = queries.op2_spotsigs(llm, tables(documents=documents(rows)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    ordered = by_id(rows)
    want = []
    for (d, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        t, after = t or "", after or ""
        q = len(t) // 4
        edited = t[:len(t) - q] + after[:q]
        near = []
        for other in (edited, after):
            a, b = chains(t), chains(other)
            near.append(round(len(a & b) / len(a | b) if a | b else 1.0, 9))
        want.append((d or -1, len(t), hashlib.sha256(edited.encode()).hexdigest(), *near))
    have = [(r.doc_id or -1, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got.collect()]
    assert sorted(have) == sorted(want)


def test_buckets_do_not_change_who_is_next(llm, documents):
    df = documents([(i * i % 101, f"text {i}") for i in range(101)] + [(None, "n")]).select("doc_id", "text")
    plans = [spotsigs.with_next(df, ["text"], n).select("doc_id", "text", "next_text").collect() for n in (1000, 9, 1)]
    assert sorted(map(str, plans[0])) == sorted(map(str, plans[1])) == sorted(map(str, plans[2]))
    one = spotsigs.with_next(documents([(1, "only")]).select("doc_id", "text"), ["text"]).collect()
    assert [r.next_text for r in one] == ["only"]


def test_near_pairs_match_brute_force(documents):
    words = (WORDS + " " + WORDS.replace("ship", "boat").replace("lamp", "bell")).split()
    rows = [(100 + k, " ".join(words[:k] + ["extra"] + words[k:])) for k in range(0, 36, 2)] + EDGE
    for floor in (0.5, 0.8):
        pairs, members = spotsigs.near_pairs(documents(rows), floor)
        rep = {r.doc_id: r.rep for r in members.collect()}
        sets = {}
        for d, t in rows:
            if d is not None and chains(t or ""):
                sets.setdefault(frozenset(chains(t)), []).append(d)
        reps = {min(ids): s for s, ids in sets.items()}
        want = {(a, b) for a in reps for b in reps if a < b
                and len(reps[a] & reps[b]) / len(reps[a] | reps[b]) >= floor}
        assert {(r.a, r.b) for r in pairs.collect()} == want
        assert rep == {d: min(ids) for ids in sets.values() for d in ids}


def test_empty_table(documents):
    assert spotsigs.edited_fingerprints(documents([])).count() == 0


def test_every_anchor_of_a_run_counts(documents):
    rows = [(1, "of the cat sat here"), (2, "in the cat sat here"), (3, "the the cat sat here")]
    got = {r.doc_id: list(r.s) for r in documents(rows).select("doc_id", spotsigs.spots(text_of()).alias("s")).collect()}
    assert [len(got[i]) for i in (1, 2, 3)] == [2, 2, 1]
    assert len(set(got[1]) & set(got[2])) == 1 and set(got[3]) == set(got[1]) & set(got[2])
