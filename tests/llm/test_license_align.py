import random

from cases import EDGE
from hypothesis import given, settings
from hypothesis import strategies as st

from spotframe.llm import license_align as la
from spotframe.llm import queries

SCAN = la.Scanner(la.TEMPLATES)


def common(a, b):
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=40))
def test_increasing_is_longest(values):
    got = [values[i] for i in la.increasing(values)]
    assert got == sorted(set(got))
    best = [1] * len(values)
    for i, v in enumerate(values):
        best[i] = 1 + max([best[j] for j in range(i) if values[j] < v], default=0)
    assert len(got) == max(best, default=0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=25), st.lists(st.sampled_from("abcdefgh"), max_size=25))
def test_patience_is_an_alignment(a, b):
    pairs = la.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
    assert len(pairs) <= common(a, b)
    if len(set(a)) == len(a) and a == b:
        assert len(pairs) == len(a)


@settings(max_examples=100, deadline=None)
@given(st.permutations(list("abcdefghij")), st.sets(st.integers(0, 9)))
def test_patience_is_best_on_unique_words(order, dropped):
    b = list("abcdefghij")
    a = [w for i, w in enumerate(order) if i not in dropped]
    assert len(la.patience(a, b)) == common(a, b)


def test_finds_repeats_edits_and_long_texts():
    rng = random.Random(3)
    noise = lambda n: " ".join(rng.choice(["alpha", "beta", "the", "of", "mit", "license"]) + str(rng.randrange(9)) for _ in range(n))
    mit = la.TEMPLATES["MIT-notice"]
    text = " ".join([noise(9000), mit, noise(3), mit, noise(9000), "Released under the MIT License.", noise(2),
                     "Released under the MIT License"])
    assert sorted((f.license, f.coverage) for f in SCAN.scan(text)) == \
        [("MIT", 1.0), ("MIT", 1.0), ("MIT-notice", 1.0), ("MIT-notice", 1.0)]
    words = mit.split()
    dropped = [w for i, w in enumerate(words) if i % 8]
    found = [f for f in SCAN.scan(noise(50) + " " + " ".join(dropped) + " " + noise(50)) if f.license == "MIT-notice"]
    assert len(found) == 1 and abs(found[0].coverage - len(dropped) / len(words)) < 0.02
    assert not [f for f in SCAN.scan(" ".join(w for i, w in enumerate(words) if i % 3)) if f.license == "MIT-notice"]
    spread = " ".join(w + (" filler" if i % 6 == 0 else "") for i, w in enumerate(words))
    assert [f.coverage for f in SCAN.scan(spread)] == [1.0]


def test_op4_query(llm, documents, tables):
    rows = EDGE + [(50, f"x y Licensed under CC BY-NC 4.0. z {la.TEMPLATES['GPL-3.0']}"), (50, "released under the mit LICENSE")]
    got = queries.op4_license_scan(llm, tables(documents=documents(rows))).collect()
    assert sorted((r.doc_id, r.license, r.coverage, r.first_word, r.last_word) for r in got) == \
        [(50, "CC-BY-NC-4.0", 1.0, 2, 8), (50, "GPL-3.0", 1.0, 10, 21), (50, "MIT", 1.0, 0, 4)]
    assert la.scan_licenses(documents([])).count() == 0


def test_lines_as_the_documents_table_writes_them(llm, documents):
    lines = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.",
             "Licensed under CC BY-NC 4.0.", "All rights reserved.",
             "This work is licensed under the GNU General Public License, version 3."]
    docs = documents([(i, f"Nt onor. The of it.\n{line}\nLes. All of the rights") for i, line in enumerate(lines)])
    got = sorted((r.doc_id, r.license, r.coverage) for r in la.scan_licenses(docs).collect())
    assert got == [(0, "Apache-2.0", 1.0), (1, "MIT", 1.0), (2, "CC-BY-NC-4.0", 1.0),
                   (3, "All-rights-reserved", 1.0), (4, "GPL-3.0", 1.0)]
