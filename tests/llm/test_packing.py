import numpy as np
import public_tokenizers
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from termlink.llm import packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def plain_best_fit(lengths, length):
    """Best fit by looking through all rows."""
    room, rows = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in range(len(rows)) if room[r] >= lengths[i]]
        if fits:
            r = min(fits, key=lambda r: room[r])
        else:
            rows.append([])
            room.append(length)
            r = len(rows) - 1
        rows[r].append(i)
        room[r] -= lengths[i]
    return sorted(room)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_fills_rows_as_the_plain_search_does(lengths):
    rows = packing.best_fit(lengths, 40)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    assert sorted(40 - sum(lengths[i] for i in r) for r in rows) == plain_best_fit(lengths, 40)


def unpacked(rows, end_id=50256):
    """Text of each (doc_id), checking the row's layout on the way."""
    enc, parts = packing.encoder(RANKS, PATTERN), {}
    for r in rows:
        ids, pos = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u4")
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and len(r.cu_seqlens) == r.n_segments + 1
        assert (ids[r.n_tokens:] == 50256).all() and (pos[r.n_tokens:] == 0).all()
        for d, p, a, b in zip(r.doc_ids, r.parts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert (pos[a:b] == np.arange(b - a)).all()
            parts.setdefault(d, {})[p] = ids[a:b]
    out = {}
    for d, by_part in parts.items():
        ids = np.concatenate([by_part[i] for i in range(len(by_part))]).tolist()
        assert ids[-1] == end_id
        out[d] = enc.decode(ids[:-1])
    return out


def test_round_trip_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = packing.pack(docs, RANKS, PATTERN, length=256, block_tokens=20_000).collect()
    assert unpacked(rows) == {r.doc_id: r.text for r in docs.collect() if r.text}
    assert len({(r.shard, r.pack) for r in rows}) == len(rows)
    assert sum(r.n_tokens for r in rows) / (256 * len(rows)) > 0.95


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "no id", "c"), (4, "x " * 9000, "d"), (5, "a<|endoftext|>b", "e"), (6, "é水\u0000", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pack string")
    got = packing.pack(docs, RANKS, PATTERN, length=64).collect()
    assert unpacked(got) == {None: "no id", 4: "x " * 9000, 5: "a<|endoftext|>b", 6: "é水\u0000"}
    assert packing.pack(docs.limit(0), RANKS, PATTERN).count() == 0


def test_repeated_rows_and_ties(spark):
    docs = spark.createDataFrame([(1, "same words here")] * 5, "doc_id long, text string")
    got = packing.pack(docs.coalesce(1), RANKS, PATTERN, length=16).collect()
    assert sum(len(r.doc_ids) for r in got) == 5


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", "some text"), ("b", "more text"), (None, "x")], "doc_id string, text string")
    rows = packing.pack(docs.coalesce(1), RANKS, PATTERN, length=8).collect()
    assert sorted((d for r in rows for d in r.doc_ids), key=str) == [None, "a", "b"]
