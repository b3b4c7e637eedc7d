import random
from collections import Counter

import numpy as np
from cases import EDGE

from spotframe.llm import dart_minhash as dm
from spotframe.llm import queries


def shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute_classes(rows, floor=0.8):
    texts = {}
    for d, t in rows:
        if d is not None:
            texts.setdefault(t or "", []).append(d)
    parent = {d: d for ids in texts.values() for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(x, y):
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)

    reps = [(min(ids), shingles(t)) for t, ids in texts.items()]
    for ids in texts.values():
        for d in ids:
            join(ids[0], d)
    for i, (a, s) in enumerate(reps):
        for b, t in reps[:i]:
            if s and t and jaccard(s, t) >= floor:
                join(a, b)
    return {d: root(d) for d in parent}


def fixture():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(8):
        base = [rng.choice(words) for _ in range(120)]
        for c in range(6):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((10_000 + g * 100 + c, " ".join(copy)))
    hub = [rng.choice(words) for _ in range(150)]
    rows += [(2000 + k, " ".join(hub[:k * 3] + ["new", "words"] + hub[k * 3 + 2:])) for k in range(45)]
    rows += [(3000, " ".join(hub)), (3001, " ".join(hub)), (3002, "same word " * 60), (3003, "same word " * 70)]
    return rows


def test_units_are_weighted_shingles():
    texts = ["a b c d e f", "a b c d e a b c d e a b c d e", "one two", "", "A  b\nc d E f"]
    doc, unit = dm.weighted_units(texts)
    assert np.bincount(doc, minlength=5).tolist() == [2, 11, 1, 0, 2]
    sets = [set(unit[doc == i].tolist()) for i in range(5)]
    assert sets[0] == sets[4]
    a, b = shingles(texts[0]), shingles(texts[1])
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) == jaccard(a, b)


def test_agreement_estimates_weighted_jaccard():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(8, 200))]
        copy = list(base)
        for _ in range(rng.randrange(0, 1 + len(base) // 10)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts += [" ".join(base), " ".join(copy)]
    doc, unit = dm.weighted_units(texts)
    sign = dm.dart_signatures(doc, unit, len(texts), 400)
    assert (sign != 0).all()
    for i in range(0, len(texts), 2):
        true = jaccard(shingles(texts[i]), shingles(texts[i + 1]))
        assert abs((sign[i] == sign[i + 1]).mean() - true) < 0.13


def test_classes_match_brute_force(documents):
    rows = fixture() + EDGE
    got = dm.near_duplicate_classes(documents(rows)).collect()
    want = brute_classes(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert [r.class_id for r in got if r.doc_id is None] == [None]


def test_bands_that_join_strangers_link_nothing(documents):
    # one coordinate per band: buckets hold many that are not alike, all of which are compared
    rng = random.Random(4)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(40):
        copy = list(base)
        for k in rng.sample(range(40), 6):
            copy[k] = f"x{i}{k}"
        rows.append((i, " ".join(copy)))
    for floor in (0.3, 0.5, 0.8):
        got = dm.near_duplicate_classes(documents(rows), floor, coordinates=40, bands=40, rows_per_band=1).collect()
        assert {r.doc_id: r.class_id for r in got} == brute_classes(rows, floor)


def test_components(llm):
    edges = [(i, i + 1) for i in range(50, 80)] + [(1, 9), (9, 4), (4, 7), (100, 101)]
    got = {r.node: r.component for r in dm.components(llm.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 50 for i in range(50, 81)}, 1: 1, 9: 1, 4: 1, 7: 1, 100: 100, 101: 100}


def test_drop_and_query(llm, documents, tables):
    rows = fixture() + EDGE
    df = documents(rows)
    want = {d for d, c in brute_classes(rows).items() if d == c}
    got = dm.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert {r.doc_id for r in got.collect()} == want | {None}
    assert dm.drop_near_duplicates(documents([])).count() == 0
    out = queries.op8_dart_minhash(llm, tables(documents=df)).collect()
    assert {r.doc_id: r.class_id for r in out if r.doc_id is not None} == brute_classes(rows)


def test_links_of_every_text_of_a_repeated_doc_id(documents):
    rng = random.Random(6)
    a, b = ([rng.choice([f"w{i}" for i in range(300)]) for _ in range(80)] for _ in range(2))
    near = lambda w: " ".join([*w[:-1], "end"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, "something else")]
    for some in (rows, rows[::-1]):
        got = dm.near_duplicate_classes(documents(some)).collect()
        assert sorted((r.doc_id, r.class_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
        assert sorted(r.doc_id for r in dm.drop_near_duplicates(documents(some)).collect()) == [1, 4]


def test_drop_keeps_columns_of_clashing_names(llm):
    rows = [(1, "one two three four five six", "a", "b", "c"), (2, "one two three four five six", "d", "e", "f")]
    df = llm.createDataFrame(rows, "doc_id int, text string, own_id string, Own_Text string, digest string")
    assert [tuple(r) for r in dm.drop_near_duplicates(df).collect()] == rows[:1]
