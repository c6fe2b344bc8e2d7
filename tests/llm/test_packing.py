import zlib

import numpy as np
import pytest

from marketlake.llm import packing, queries

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def whole(texts):
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    return [[*e.ids, 0] for e in t.encode_batch(texts, add_special_tokens=False)]


def check(rows, texts_by_id, window=1024):
    ids = dict(zip(texts_by_id, whole([x or "" for x in texts_by_id.values()]), strict=True))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(own) and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
    assert by_doc.keys() == ids.keys()
    for doc_id, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[doc_id])
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_query_over_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas()
    rows = queries.op2_packing(spark, "/root/testdata/sf0.01").collect()
    assert check(rows, dict(zip(docs.doc_id.tolist(), docs.text, strict=True))) == 0


def test_edge_texts(spark):
    texts = {1: None, 2: "", 3: "a", 4: " lead", 5: "trail ", 6: "two  spaces", 7: "tab\t x", 8: "line \n next\n\n  end", 9: "nb  space 　x", 10: "<|endoftext|> here <|endoftext|>", 11: "nul\0 in \0 it", 12: "word " * 5000, 13: "it's we'll 12 3,4 é漢字 🙂 🙂🙂", 14: "x" * 3000, 15: "word " * 5000}
    docs = spark.createDataFrame([(k, v, "z") for k, v in texts.items()], "doc_id long, text string, ids string")
    assert check(queries.pieces_of(docs).collect(), texts) == 0
    assert queries.pieces_of(docs.where("false")).count() == 0


def test_stretches_change_no_id():
    encode = packing.Encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    text = "it's  we'll 12 3,4 \n é漢字 🙂 's x\t y  z 'll end " * 40
    for size in (1, 7, 50, 10_000):
        parts = list(packing.Encoder.stretches(text, size))
        assert "".join(parts) == text and (size > len(text) or len(parts) > 1)
        assert [i for x in parts for i in encode.fast.encode_ordinary(x)] == whole([text])[0][:-1]
    assert np.frombuffer(encode.encode(text), np.uint32).tolist() == whole([text])[0][:-1]


def test_nulls_repeats_and_whole_sequences(spark):
    """Null and repeated doc_ids are packed each for themselves, and the sequences hold every id once."""
    rows = [(None, "a b c"), (None, None), (1, "one two"), (1, "one two"), (1, "three " * 1500), (2, "x" * 50)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, ids string").repartition(3)
    tokens = packing.tokenized(docs, 64, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    pieces = packing.pack(tokens, 64)
    want = sorted(zip((str(d) for d, _ in rows), whole([t or "" for _, t in rows]), strict=True))
    got = {}
    for r in sorted(pieces.collect(), key=lambda r: r.start):
        own = got.setdefault((r.part, r.row), [r.doc_id, 0, r.doc_tokens])
        assert own[0] == r.doc_id and own[1] == r.start
        own[1] += r.length
    assert sorted((str(d), n) for d, n, _ in got.values()) == [(d, len(ids)) for d, ids in want] and all(n == m for _, n, m in got.values())
    made = {r.sequence_id: np.frombuffer(r.ids, np.uint32).tolist() for r in packing.sequences(pieces, tokens).collect()}
    held = {(r.part, r.row): np.frombuffer(r.ids, np.uint32).tolist() for r in tokens.collect()}
    for r in pieces.collect():
        assert made[r.sequence_id][r.offset : r.offset + r.length] == held[r.part, r.row][r.start : r.start + r.length]
    assert sum(map(len, made.values())) == sum(len(ids) for _, ids in want) and max(map(len, made.values())) == 64


@pytest.mark.parametrize("histogram", [{600: 1000}, {1: 7}, {1023: 5, 1: 5}, {341: 100, 342: 50}, {512: 3}, {700: 11, 300: 4, 25: 9, 3: 2}])
def test_plan_places_every_token_once(histogram):
    window = 1024
    counts = np.zeros(window, np.int64)
    for k, v in histogram.items():
        counts[k] = v
    plan = packing.Plan(counts, window)
    filled, seen = {}, {}
    for tail, n in histogram.items():
        for hit, start, length, sequence, offset in plan.lookup().pieces(np.full(n, tail), np.arange(n)):
            for i, s, size, q, o in zip(hit.tolist(), start.tolist(), length.tolist(), sequence.tolist(), offset.tolist(), strict=True):
                seen.setdefault((tail, i), []).append((s, size))
                filled.setdefault(q, []).append((o, size))
    for tail, n in histogram.items():
        for i in range(n):
            at = 0
            for s, size in sorted(seen[tail, i]):
                assert s == at
                at += size
            assert at == tail
    totals = []
    for own in filled.values():
        at = 0
        for o, size in sorted(own):
            assert o == at
            at += size
        totals.append(at)
    assert all(t & (t - 1) == 0 for t in totals) and sum(t < window for t in totals) <= 10
    assert sorted(filled) == list(range(plan.n_sequences))


def test_least_squares_fills_a_solvable_histogram():
    counts = np.zeros(64, np.int64)
    counts[40], counts[24], counts[20], counts[4] = 300, 100, 200, 200
    columns = packing.combinations(64, counts > 0)
    found = dict(zip(columns, packing.repeat_counts(counts, columns), strict=True))
    assert round(found[(40, 24)]) + round(found[(40, 20, 4)]) == 300
