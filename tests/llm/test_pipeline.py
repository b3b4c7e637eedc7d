import corpus_pipeline
import numpy as np
from cases import EDGE
from test_dart_minhash import brute_classes
from test_exact_dedup import LOWER
from test_quality_fm import LABELS, corpus
from test_tokens import check_packing

from spotframe.llm import quality_fm


def test_pipeline_matches_recomputation(llm, documents, tables):
    rows, labels = corpus()
    rows = rows[:200] + [(5000 + i, t) for i, t in rows[:40]] + [(6000 + i, t.replace(".", " x.")) for i, t in rows[1:60]] + EDGE[:3]
    df = documents(rows)
    path = tables(documents=df, labels=llm.createDataFrame(labels, LABELS))
    got = corpus_pipeline.run(llm, path).collect()

    model = quality_fm.fit(df, llm.read.parquet(f"{path}/labels.parquet"))
    good = model.probability(quality_fm.features([t or "" for _, t in rows])) >= 0.3
    kept = [r for r, g in zip(rows, good) if g]
    assert 0 < len(kept) < len(rows)
    last = {}
    for d, t in kept:
        key = (t or "").translate(LOWER)
        last[key] = max(last.get(key, (-1, "")), (d, t or ""))
    classes = brute_classes(list(last.values()))
    final = [(d, t) for d, t in last.values() if classes[d] == d]
    assert len(final) < len(last) < len(kept)
    check_packing(got, final, 2048)


def test_stages_keep_columns_and_take_empty_tables(llm, documents, tables):
    empty = documents([])
    path = tables(documents=empty, labels=llm.createDataFrame([], LABELS))
    for name, step in corpus_pipeline.STAGES:
        out = step(llm, empty, path)
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == empty.columns
    assert corpus_pipeline.run(llm, path).count() == 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and np.all([callable(f) for _, f in corpus_pipeline.STAGES])
