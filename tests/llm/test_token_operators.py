"""Token counts from the digest cache and alignment of two tokenizers, against the libraries on whole texts."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from llm_helpers import documents, rows_of
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from hazardflow.llm import cross_tokens, queries, token_counts
from hazardflow.llm.pieces import ChunkEncoder, file_digest
from hazardflow.session import shared_dir

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a ", " a", "  a  b ", "▁", "a▁b", "▁▁x", "\n", "a\n\nb", "\t x", " \n ", "<s> </s> <unk> <0x41>",
    "日本語 text 🙂🙂", "a b　c", "x" * 500, "\u0000a", "é ﬁ", "​", "<|endoftext|> x", "á" * 3, "a  ▁ b   ",
]


@pytest.fixture(scope="module")
def model():
    return SentencePieceProcessor(model_file=MODEL)


def cached_rows(spark, cache):
    return spark.read.parquet(f"{cache}/*/*").count()


def test_chunks_equal_whole_texts(spark, small, model):
    texts = [t or "" for t in ODD] + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    encoder = ChunkEncoder(MODEL, entries=300)
    assert encoder.separable
    wanted = model.encode(texts)
    for begin in range(0, len(texts), 7):
        found = encoder.encode(texts[begin : begin + 7])
        assert [list(memoryview(f).cast("I")) for f in found] == wanted[begin : begin + 7]


def test_counts_equal_the_library(spark, small, model):
    found = {r.doc_id: r for r in queries.op12_token_counts(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d, ids in zip(docs, model.encode([d.text or "" for d in docs])):
        row = found[d.doc_id]
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (len(ids), len((d.text or "").encode()), len(ids) > 4096)


def test_counts_of_odd_rows(spark, model):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (0, "again"), (0, "again"), (99, "w " * 5000)]
    cache = shared_dir(spark, "counts")
    found = rows_of(token_counts.counted(documents(spark, rows), cache))
    wanted = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in rows]
    assert found == sorted(wanted, key=repr)
    assert token_counts.counted(documents(spark, []), shared_dir(spark, "counts")).count() == 0


def test_extra_columns_and_other_libraries(spark):
    rows = documents(spark, [(1, "One two"), (2, None), (3, "<|endoftext|> x")])
    odd = rows.withColumns({c: F.lit("x") for c in ("content", "n_tokens", "_n", "n_bytes", "batch")})
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        found = token_counts.counted(odd, shared_dir(spark, "counts"), vocab=name).collect()
        texts = {1: "One two", 2: "", 3: "<|endoftext|> x"}
        assert {r.doc_id: r.n_tokens for r in found} == {
            i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()
        }


def test_only_distinct_misses_are_encoded(spark):
    """Copies and stored texts are not encoded again; another tokenizer has its own counts."""
    cache = shared_dir(spark, "counts")
    first = documents(spark, [(i, "same text") for i in range(50)] + [(60, "other"), (61, None), (62, ""), (63, "same▁text")])
    token_counts.counted(first, cache).collect()
    assert cached_rows(spark, cache) == 3
    more = documents(spark, [(1, "same text"), (2, "new"), (3, "new"), (4, "other")])
    again = token_counts.counted(more, cache)
    assert {r.doc_id: r.n_tokens for r in again.collect()} == {1: 2, 2: 1, 3: 1, 4: 1}
    assert cached_rows(spark, cache) == 4
    token_counts.counted(more, cache, vocab="byte_bpe_50k.json").collect()
    assert cached_rows(spark, cache) == 7
    assert token_counts.tokenizer_digest("byte_bpe_50k.json") != token_counts.tokenizer_digest("piece_bpe_32k.model")
    assert file_digest(MODEL) == hashlib.sha256(open(MODEL, "rb").read()).hexdigest()


def test_stored_counts_are_used(spark):
    """What the cache says is the answer; a batch appended twice changes nothing."""
    cache = shared_dir(spark, "counts")
    text = documents(spark, [(1, "planted")])
    planted = text.select(token_counts.content_digest(F.col("text")).alias("content"), F.lit(77).cast("long").alias("n_tokens"))
    folder = f"{cache}/tokenizer={token_counts.tokenizer_digest(token_counts.MODEL)}"
    for batch in ("a", "b"):
        planted.write.parquet(f"{folder}/batch={batch}")
    assert [r.n_tokens for r in token_counts.counted(text, cache).collect()] == [77]


# Alignment


def brute_alignment(rows):
    """The contract in plain Python, token by token."""
    a_lib, b_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=MODEL)
    a_lib.encode_special_tokens = True
    from tokenizers.decoders import ByteLevel

    vocab = {i: t for t, i in a_lib.get_vocab().items()}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    letters |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in printable)}
    assert ByteLevel() is not None

    def b_bytes(i):
        piece = b_lib.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_lib.is_byte(i) else piece.replace("▁", " ").encode()

    out = []
    for doc, text in rows:
        wanted = b" " + (text or "").encode()
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        a_all, b_all = [bytes(letters[c] for c in vocab[i]) for i in a], [b_bytes(i) for i in b]
        if b"".join(a_all) != wanted or b"".join(b_all) != wanted:
            out.append((doc, [], []))
            continue
        groups, i, j, at_a, at_b = [], 0, 0, 0, 0
        while i < len(a):
            own = ([], [])
            while not own[0] or at_a != at_b:
                if at_a <= at_b:
                    own[0].append(a[i])
                    at_a += len(a_all[i])
                    i += 1
                else:
                    own[1].append(b[j])
                    at_b += len(b_all[j])
                    j += 1
            groups.append(own)
        out.append((doc, groups, [(g[0][-1], g[1][-1]) for g in groups]))
    counts = Counter(p for _, _, links in out for p in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    result = []
    for doc, groups, links in out:
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        result.append(
            (
                doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
                hashlib.sha256(written.encode()).hexdigest() if groups else "",
            )
        )
    return sorted(result, key=repr)


def test_alignment_against_plain_code(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = rows_of(queries.op13_cross_tokens(spark, small))
    assert found == brute_alignment([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[4] for r in found) > 10_000


def test_alignment_of_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (0, "again"), (0, "again"), (99, "wörd, " * 5000)]
    docs = documents(spark, rows).withColumns({c: F.lit("x") for c in ("pairs", "n", "best", "n_a", "groups_sha256")})
    assert rows_of(cross_tokens.cross_aligned(docs)) == brute_alignment(rows)
    assert cross_tokens.cross_aligned(documents(spark, [])).count() == 0


def test_links_in_small_runs(spark, monkeypatch):
    """Runs of few links and few characters give the same result."""
    own = cross_tokens.vocabularies(public_tokenizers.path(cross_tokens.A_VOCABULARY), MODEL)
    texts = ["Hello there, naïve world", "", "one", "x▁y", "日本 text"]
    together, pairs = cross_tokens._align_texts(texts, own)
    for i, text in enumerate(texts):
        alone, own_pairs = cross_tokens._align_texts([text], own)
        assert alone.digests[0] == together.digests[i] and own_pairs[0] == pairs[i]


def test_pairs_are_bounded_by_the_vocabularies(spark, small):
    own = cross_tokens.vocabularies(public_tokenizers.path(cross_tokens.A_VOCABULARY), MODEL)
    bound = own.possible_pairs()
    counts = cross_tokens.pair_counts(cross_tokens.align(spark.read.parquet(f"{small}/documents.parquet")))
    a, b = own.a.to_pylist(), own.b.to_pylist()
    pairs = counts.collect()
    assert 0 < len(pairs) <= bound < 1_000_000
    assert all(a[p.id_a].endswith(b[p.id_b]) or b[p.id_b].endswith(a[p.id_a]) for p in pairs)
