import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import EDGE

from spotframe.llm import byte_bpe, queries

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ENC = reference()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab Zé'sre.,!%\n\t 12²Ώ \x1c<|>"), max_size=80), st.integers(1, 6))
def test_cut_texts_encode_alike(text, span):
    assert "".join(byte_bpe.spans(text, span)) == text
    got = np.frombuffer(byte_bpe.encode_text(ENC, text, span), "<u4").tolist()
    assert got == ENC.encode_ordinary(text)


def test_op10_query(llm, documents, tables):
    rows = EDGE + [(20, "one word " * 20_000), (21, "y" * 70_000)]
    got = queries.op10_byte_bpe(llm, tables(documents=documents(rows))).collect()
    want = []
    for d, t in rows:
        ids = ENC.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_null_ids_and_empty_table(llm, documents):
    from pyspark.sql import functions as F
    df = llm.createDataFrame([(None,), (bytearray(np.array([5, 9], "<u4").tobytes()),)], "ids binary")
    got = [r[0] for r in df.select(byte_bpe.decode(F.col("ids"), RANKS, P.PATTERN)).collect()]
    assert got == [None, bytearray(ENC.decode_bytes([5, 9]))]
    assert documents([]).select(byte_bpe.encode(F.col("text"), RANKS, P.PATTERN)).count() == 0
