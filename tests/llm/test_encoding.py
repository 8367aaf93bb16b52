"""Encoding, packing and record files against the tokenizer libraries and exact round trips."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from llm_helpers import documents

import public_tokenizers as vocabularies
from hazardflow.llm import binary_records, bpe, packing, queries
from hazardflow.llm.encoding import PieceEncoder, vocabulary

ODD = [
    "", " ", "  ", "\n", "a\n", "a \nb", " a", "\ta  b", "x y 　z", "don't  we'll\r\n\r\nok", "日本語 テキスト 12 3", "a" * 50,
    "é è\n\nô", "🙂 🙂\n🙂", None, " \n ", "\na", "a b ", "0 1  2", "<|endoftext|> a<|endoftext|>b", "it's 'tis\n's", "a\x1cb", "word " * 20_000,
]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def ranked():
    import tiktoken

    lines = open(vocabularies.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    t = tiktoken.Encoding("t", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: t.encode_ordinary(text or "")


def test_pieces_equal_whole_texts(whole):
    random.seed(3)
    letters = ["a", "B", "é", "ß", " ", "\n", "1", ".", "'s", "!", "\t", "日", "🙂", "'", " ", "-", "ŉ", "µ", "́"]
    texts = [t or "" for t in ODD] + ["".join(random.choices(letters, k=random.randint(0, 14))) for _ in range(5_000)]
    encoder = PieceEncoder(vocabulary("byte_bpe_50k.json"), entries=500)
    for i in range(0, len(texts), 200):  # the cache is emptied in between
        some = texts[i : i + 200]
        for text, ids in zip(some, encoder.encode(some)):
            assert np.frombuffer(ids, "<u4").tolist() == whole(text), repr(text)


def test_corpus_wide_encoding(spark, ranked):
    docs = documents(spark, [*enumerate(ODD), (0, "again"), (None, "no id"), (0, "again")])
    texts = [*ODD, "again", "no id", "again"]
    want = sorted(
        (str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t, ids in ((i, t, ranked(t)) for i, t in zip([*range(len(ODD)), 0, None, 0], texts))
    )
    assert sorted((str(r[0]), *r[1:]) for r in bpe.digests(docs).collect()) == want
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(bytes(r["bytes"]) for r in back) == sorted((t or "").encode() for t in texts)


def test_several_chunks_and_an_empty_table(spark, ranked, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 50)
    texts = [f"word{i} the {'x' * (i % 7)} and\nmore" for i in range(60)]
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode(documents(spark, enumerate(texts))).collect()}
    assert got == {i: ranked(t) for i, t in enumerate(texts)}
    assert bpe.digests(documents(spark, [])).count() == 0


def test_whole_table_round_trip(spark, small, ranked):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op4_bpe_round_trip(spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = ranked(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_records_in_id_order(spark, small, whole):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    want, start = [], 0
    for i, text in docs:
        ids = [*whole(text), 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op5_binary_records(spark, small).collect()) == want


def test_record_files_with_odd_rows(spark, whole):
    docs = documents(spark, [*((10 * i, t) for i, t in enumerate(ODD)), (None, "no id"), (20, "again"), (20, "again"), (-5, "minus")])
    folder = binary_records.new_folder(spark)
    index = binary_records.write_records(docs.withColumn("file", docs.lang), folder, shard_rows=5, file_bytes=600)
    read = binary_records.read_records(spark, folder, with_ids=True).collect()
    texts = [*ODD, "no id", "again", "again", "minus"]
    assert sorted(r.ids for r in read) == sorted([*whole(t), 0] for t in texts)
    ordered = sorted(read, key=lambda r: (r.file, r.offset))
    ids = [-(2**63) if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids) and ordered[0].doc_id is None
    starts = binary_records.token_starts(index, binary_records.read_records(spark, folder)).orderBy("file", "offset").collect()
    assert [r.start for r in starts] == np.cumsum([0, *(len(r.ids) for r in ordered)])[:-1].tolist()
    shuffled = binary_records.read_shuffled(index, folder, seed=1).collect()
    assert sorted(r.ids for r in shuffled) == sorted(r.ids for r in read)


def test_damage_is_noticed_and_empty_tables_work(spark):
    record = binary_records.frame(b"payload")
    assert binary_records.unframe(record) == (b"payload", len(record))
    for i in range(len(record)):
        damaged = bytearray(record)
        damaged[i] ^= 1
        with pytest.raises((ValueError, Exception)):
            binary_records.unframe(bytes(damaged))
    folder = binary_records.new_folder(spark)
    index = binary_records.write_records(documents(spark, []), folder)
    assert index.count() == 0 and binary_records.read_records(spark, folder).count() == 0


def check_packing(pieces, lengths_of, capacity):
    by_sequence, by_doc = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault(p.doc_id, []).append(p)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, n in lengths_of.items():
        own = sorted(by_doc[doc], key=lambda p: p.piece)
        assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        assert sum(p.length for p in own) == n and all(p.length == capacity for p in own[1:])
    return len(by_sequence)


def test_packing_of_a_table(spark, small, whole):
    docs = {r.doc_id: [*whole(r.text), 0] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    pieces = queries.op7_best_fit_packing(spark, small).collect()
    n = check_packing(pieces, {d: len(ids) for d, ids in docs.items()}, 2048)
    assert n <= 1.02 * -(-sum(map(len, docs.values())) // 2048) + 1
    for p in pieces:
        assert zlib.crc32(np.array(docs[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32


def test_packing_of_odd_rows(spark, whole):
    docs = documents(spark, [*enumerate(ODD), *((1000 + i, "same text here") for i in range(900))])
    lengths = {i: len(whole(t)) + 1 for i, t in enumerate(ODD)} | {1000 + i: len(whole("same text here")) + 1 for i in range(900)}
    pieces = packing.pack(packing.token_pieces(docs, capacity=64), capacity=64, group_rows=7).collect()
    check_packing(pieces, lengths, 64)
    assert packing.pack(packing.token_pieces(documents(spark, []))).count() == 0
    nobody = packing.pack(packing.token_pieces(documents(spark, [(None, "x"), (None, "x")]))).collect()
    assert len(nobody) == 2 and len({(p.sequence_id, p.offset) for p in nobody}) == 2


@pytest.mark.parametrize("seed", range(8))
def test_plans_are_whole_and_tight(seed):
    random.seed(seed)
    capacity = 100
    counts = {random.randint(1, capacity): random.choice([1, 2, 7, 1000]) for _ in range(random.randint(1, 60))}
    plan = packing.solve(counts, capacity)
    fill = {}
    for length, runs in plan.runs.items():
        ranks = sorted(r for first, n, _, _ in runs for r in range(first, first + n))
        assert ranks == list(range(counts[length]))
        for _, n, sequence, offset in runs:
            for s in range(sequence, sequence + n):
                fill.setdefault(s, []).append((offset, length))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    plain = packing.Plan(counts, capacity)
    plain.best_fit()
    assert len(fill) == plan.sequences <= 1.02 * plain.sequences + 2


def test_exact_complements_fill_sequences():
    plan = packing.solve({60: 10, 40: 10, 30: 6, 70: 2, 25: 8}, 100)
    assert plan.sequences == -(-(600 + 400 + 180 + 140 + 200) // 100)
