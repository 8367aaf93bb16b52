"""Near duplicates and components against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import documents

import corpus_pipeline
from hazardflow.llm import near_dup, queries
from hazardflow.llm.components import components
from hazardflow.llm.shingles import common, shingle_sets


def brute_sets(text, words=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def brute_components(docs, percent=85):
    sets = defaultdict(list)
    for i, text in docs:
        sets[brute_sets(text)].append(i)
    keys = [s for s in sets if s]
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(keys):
        for shingle in s:
            holders[shingle].append(k)
    for k, s in enumerate(keys):
        for other, both in Counter(o for x in s for o in holders[x] if o > k).items():
            if 100 * both >= percent * (len(s) + len(keys[other]) - both):
                parent[find(other)] = find(k)
    groups = defaultdict(list)
    for k, s in enumerate(keys):
        groups[find(k)] += sets[s]
    out = {i: (len(brute_sets(t)), i) for i, t in docs}
    for ids in groups.values():
        for i in ids:
            out[i] = (out[i][0], min(ids))
    return out


def compare(rows, docs):
    want = brute_components(docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id), r


def test_whole_table(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    compare(queries.op6_near_duplicates(spark, small).collect(), docs)


def edited(words, n, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"edit{rng.randint(0, 10**9)}"
    return " ".join(out)


def test_large_groups_of_copies_chains_and_odd_rows(spark, monkeypatch):
    """Groups larger than a bucket block and a comparison group; chains; links just above and below the limit."""
    monkeypatch.setattr(near_dup, "GROUP_SHINGLES", 500)
    monkeypatch.setattr(near_dup, "ID_BITS", 256)
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randint(0, 10**6))
    texts = [None, "", " \n", "one", "One", "two words", "two  WORDS", "\t", "È a b c d", "è a b c d"]
    base = [word() for _ in range(150)]
    texts += [" ".join(base)] * 40 + [edited(base, rng.randint(1, 4), rng) for _ in range(60)]
    chain = [word() for _ in range(120)]
    for _ in range(25):
        chain = chain[1:] + [word()]
        texts.append(" ".join(chain))
    shared = [word() for _ in range(70)]
    texts += [" ".join(shared + [word() for _ in range(40)]) for _ in range(50)]
    for n in range(20):
        pair = [word() for _ in range(100 + n)]
        texts += [" ".join(pair), " ".join(pair[: 88 + n // 2] + [word() for _ in range(12)])]
    texts.append(" ".join(word() for _ in range(30_000)))
    texts.append(texts[-1] + " tail")
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    frame = documents(spark, docs).withColumnRenamed("lang", "node").withColumnRenamed("source", "key")
    compare(near_dup.near_duplicates(frame).collect(), docs)


def test_blocks_find_what_centers_miss(spark, monkeypatch):
    """A group in which many links do not lead to the center."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(140)]
    docs = list(enumerate(edited(base, rng.choice([1, 2, 3, 4, 5, 6]), rng) for _ in range(80)))
    compare(near_dup.near_duplicates(documents(spark, docs)).collect(), docs)


def test_missing_and_repeated_ids(spark):
    text = "a b c d e f g"
    rows = near_dup.near_duplicates(documents(spark, [(None, text), (None, text), (4, text), (4, text), (9, text)])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in rows) == [
        ("4", "4", True), ("4", "4", True), ("9", "4", False), ("None", "None", True), ("None", "None", True),
    ]
    kept = near_dup.one_of_each(documents(spark, [(None, text), (None, text), (4, text), (4, text), (9, text)]))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "None", "None"]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert near_dup.near_duplicates(documents(spark, [])).count() == 0


def test_shingles_equal_plain_sets():
    rng = random.Random(2)
    letters = ["a", "B", "b", " ", " ", "\n", "\x0b", "é", "É", "\xa0", "\x1c", "🙂"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(400)]
    sets, plain = shingle_sets(texts), [brute_sets(t) for t in texts]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for i in range(0, 400, 7):
        for j in range(400):
            assert common(sets[i], sets[j]) == len(plain[i] & plain[j])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for similarity in (0.3, 0.6, 0.85, 0.95):
        n = 2000
        both = int(2 * n * similarity / (1 + similarity))
        x = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = x[:n], np.concatenate([x[:both], x[n : 2 * n - both]])
        agree = (near_dup.signature(np.sort(a)) == near_dup.signature(np.sort(b))).mean()
        assert abs(agree - similarity) < 0.15


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(60)] + [(7, 7), (500, None)]
    edges += [(1000, 1000 - i) for i in range(1, 30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if v is not None and u != v:
            parent[max(find(u), find(v))] = min(find(u), find(v))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_threshold_of_signatures_loses_few_links():
    def lost(percent):
        p = percent / 100
        return sum(math.comb(192, k) * p**k * (1 - p) ** (192 - k) for k in range(near_dup.least_agreement(percent)))

    assert near_dup.least_agreement(85) == 132
    assert all(0 < lost(percent) <= 5e-9 for percent in (80, 82, 85, 90))
    for percent in (80, 85):
        rows = near_dup.rows_of_band(percent)
        assert (1 - (percent / 100) ** rows) ** (192 // rows) < 3e-7


def test_pairs_between_80_and_85_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(11)
    texts = []
    for n in range(240):  # sizes differ, too: the shorter text is a part of the longer one
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(104)]
        texts += [" ".join(base), " ".join(base[: 82 + n % 8] if n % 2 else base[:94] + [f"x{rng.randint(0, 10**6)}" for _ in range(8 + n % 5)])]
    base = [f"b{i}" for i in range(140)]  # links that do not lead to a center
    texts += [edited(base, rng.choice([2, 3, 4, 5]), rng) for _ in range(60)]
    sets = [brute_sets(t) for t in texts]

    def alike(i, j, percent):
        both = len(sets[i] & sets[j])
        return 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)

    links = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if alike(i, j, 80)]
    assert sum(not alike(i, j, 85) for i, j in links) > 100
    label = list(range(len(texts)))
    for i, j in links:
        low, high = sorted((label[i], label[j]))
        label = [low if x == high else x for x in label]
    frame = documents(spark, list(enumerate(texts)))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame, percent=80).collect()}
    assert got == dict(enumerate(label))
    kept = corpus_pipeline.near_duplicates(spark, frame, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
