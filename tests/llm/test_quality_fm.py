import random
import zlib

import numpy as np
from cases import EDGE

from spotframe.llm import queries, quality_fm

LABELS = "doc_id long, quality int, toxic int"


def test_sum_of_squares_identity():
    f = quality_fm.features(["a b a c", "", "X!! Y!!\nX!! Y!!", "d " * 50])
    m = quality_fm.train(f, np.array([1.0, 1.0, 0.0, 0.0]), rounds=3)
    start, slot, value = m.rows(f)
    got, _ = m.margin(start, slot, value)
    for i in range(4):
        s, x = slot[start[i]:start[i + 1]], value[start[i]:start[i + 1]]
        pairs = sum(m.factors[s[a]] @ m.factors[s[b]] * x[a] * x[b] for a in range(len(s)) for b in range(a))
        assert abs(got[i] - (m.bias + m.linear[s] @ x + pairs)) < 1e-9


def test_scores_do_not_depend_on_the_batch():
    texts = ["one two three", "", "A | B | c\nd", "twice twice", "ümläut 12 %%%"]
    m = quality_fm.train(quality_fm.features(texts), np.array([1.0, 0, 1, 0, 1]), rounds=2)
    alone = [m.probability(quality_fm.features([t]))[0] for t in texts]
    assert np.allclose(m.probability(quality_fm.features(texts)), alone)


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(700):
        good = i % 3 > 0
        some = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        rows.append((i, " ".join(some).capitalize() + "." if good else "!! ".join(some).upper() + "%%%"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_op5_query(llm, documents, tables):
    rows, labels = corpus()
    labels += [(None, 1, 0), (3, None, 0), (90_000, 0, 0), (5, 0, 1)]
    rows += [(None, "no id"), (1000, None), (1000, ""), (1001, "long " * 30_000)]
    path = tables(documents=documents(rows), labels=llm.createDataFrame(labels, LABELS))
    got = queries.op5_quality_fm(llm, path).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    truth = {i: q for i, q, _ in labels[:700]}
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.97
    empty = [r.score for r in got if r.doc_id == 1000]
    assert len(empty) == 2 and empty[0] == empty[1]


def test_no_labels_one_class_and_empty_tables(llm, documents):
    df = documents(EDGE)
    none = quality_fm.fit(df, llm.createDataFrame([], LABELS))
    assert {r.score for r in quality_fm.score(df, none).collect()} == {0.5}
    ones = quality_fm.fit(df, llm.createDataFrame([(i, 1, 0) for i in range(20)], LABELS))
    assert min(r.score for r in quality_fm.score(df, ones).collect()) > 0.5
    assert quality_fm.score(documents([]), ones).count() == 0
    kept = quality_fm.keep_good(df, ones)
    assert kept.columns == df.columns and kept.count() == df.count()
    assert quality_fm.keep_good(df, none, threshold=0.6).count() == 0
