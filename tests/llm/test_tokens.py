import zlib

import numpy as np
import pytest
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cases import EDGE

from spotframe.llm import best_fit, queries, token_files
from spotframe.llm.tokenize import encoder
from spotframe.session import shared_folder

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def whole(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(st.sampled_from("ab Zé ü'.,!%\n\t 12²Ώ  \x1c<|endoftext|>Σİß"), max_size=20),
                          st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " "])), max_size=6).map("".join))
def test_units_encode_as_the_whole_text(text):
    for path, keep in ((BYTE, True), (WORD, False)):
        got = np.frombuffer(encoder(path, "<u4", keep).encode(text), "<u4").tolist()
        assert got == whole(path)(text)


def expected_files(rows):
    ids = whole(BYTE)
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        body = ids(text) + [0]
        out.append((doc, start, len(body), zlib.crc32(np.array(body, "<u4").tobytes()), body))
        start += len(body)
    return out


def test_files_round_trip_over_many_shards(llm, documents):
    folder = shared_folder(llm, "test-tokens")
    token_files.write_token_files(documents(EDGE), folder, BYTE, 50_257, shard_bytes=64, partitions=3)
    got = token_files.read_documents(llm, folder).collect()
    have = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32, list(r.ids)) for r in got)
    assert have == [(s, d, n, c, b) for d, s, n, c, b in expected_files(EDGE)]
    manifest = llm.read.parquet(f"{folder}/manifest").orderBy("base").collect()
    assert len(manifest) > 3
    assert [m.base for m in manifest] == np.cumsum([0, *[m.tokens for m in manifest]])[:-1].tolist()
    assert token_files.read_documents(llm, folder, True).select(F.spark_partition_id()).distinct().count() > 1
    shard = token_files.TokenShard(folder, manifest[0].name, manifest[0].dtype)
    assert isinstance(shard.ids, np.memmap) and len(shard) == manifest[0].documents


def test_wide_ids_and_empty_table(llm, documents):
    assert token_files.id_type(65_536) == "<u2" and token_files.id_type(65_537) == "<u4"
    folder = shared_folder(llm, "test-tokens")
    token_files.write_token_files(documents(EDGE), folder, BYTE, 1 << 20)
    got = sorted((r.start, r.ids_crc32) for r in token_files.read_documents(llm, folder, True).collect())
    assert got == [(s, c) for _, s, _, c, _ in expected_files(EDGE)]
    folder = shared_folder(llm, "test-tokens")
    token_files.write_token_files(documents([]), folder, BYTE, 50_257)
    assert token_files.read_documents(llm, folder).count() == 0


def test_op1_query(llm, documents, tables):
    rows = [r for r in EDGE if r[0] is not None]
    got = queries.op1_token_files(llm, tables(documents=documents(rows))).collect()
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == \
        [(s, d, n, c) for d, s, n, c, _ in expected_files(rows)]


def plain_best_fit(lengths, capacity):
    rooms, total = [], []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            r = min(fits)
            rooms[rooms.index(r)] = r - n
        else:
            rooms.append(capacity - n)
        total.append(n)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80))
def test_segment_tree_finds_the_tightest_bin(lengths):
    bins, offsets = best_fit.best_fit_decreasing(np.array(lengths, np.int64), 32)
    rooms = {}
    for b, o, n in sorted(zip(bins, offsets, lengths)):
        assert o == 32 - rooms.get(b, 32)
        rooms[b] = rooms.get(b, 32) - n
        assert rooms[b] >= 0
    assert sorted(rooms.values()) == plain_best_fit(lengths, 32)


def check_packing(got, rows, capacity):
    ids = whole(WORD)
    want = []
    for doc, text in rows:
        body = ids(text) + [0]
        for k in range(0, len(body), capacity):
            part = body[k:k + capacity]
            want.append((doc, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    places = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert places.get(r.sequence_id, 0) == r.offset
        places[r.sequence_id] = r.offset + r.length
    assert not places or max(places.values()) <= capacity
    return places


def test_packing_places_every_piece_once(documents):
    for groups in (200_000, 4):
        got = best_fit.pack_documents(documents(EDGE), WORD, capacity=64, group_rows=groups).collect()
        check_packing(got, EDGE, 64)
    assert best_fit.pack_documents(documents([]), WORD).count() == 0


def test_sequences_hold_the_ids(documents):
    docs = documents(EDGE)
    placed = best_fit.pack_documents(docs, WORD, capacity=64)
    rows = best_fit.sequences(docs, placed, WORD, capacity=64).collect()
    assert len(rows) == placed.select("sequence_id").distinct().count()
    bodies = {d: np.array(whole(WORD)(t) + [0], "<u4") for d, t in EDGE}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == sum(r.lengths) <= 64
        if len(r.doc_ids) == 1 and r.lengths[0] <= 64 and len(bodies[r.doc_ids[0]]) == r.lengths[0]:
            assert (ids == bodies[r.doc_ids[0]]).all()


def test_op6_query_is_tight(llm, documents, tables):
    rows = [(i, "word " * (i * 37 % 900)) for i in range(300)]
    got = queries.op6_best_fit_packing(llm, tables(documents=documents(rows))).collect()
    places = check_packing(got, rows, 2048)
    assert len(places) <= -(-sum(places.values()) // 2048) + 1


def test_special_strings_are_special_ids():
    text = "one  <|endoftext|> two<|endoftext|>"
    for path, keep, special in ((BYTE, True, 50256), (WORD, False, 49407)):
        got = np.frombuffer(encoder(path, "<u4", keep).encode(text), "<u4").tolist()
        assert got == whole(path)(text) and got.count(special) == 2


def test_packing_refuses_and_keeps_clashing_columns(llm):
    pieces = llm.createDataFrame([(1, 5, "a"), (2, 7, "b")], "key long, length long, packing_group string")
    got = best_fit.pack(pieces, 16).collect()
    assert sorted((r.key, r.packing_group) for r in got) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        best_fit.pack(pieces.withColumnRenamed("packing_group", "Offset"))
