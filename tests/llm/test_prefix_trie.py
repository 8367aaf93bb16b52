"""The trie of conversations against plain code, at several band heights, with hot and odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from llm_helpers import rows_of
from pyspark.sql import functions as F

from hazardflow.llm import prefix_trie as T
from hazardflow.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def plain_turns(rows):
    """Ordered turns of every conversation."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}


def plain_rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def plain_trie(turns):
    members = defaultdict(list)
    for c, own in turns.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    children = defaultdict(list)
    for name in members:
        if name:
            children[name[:-1]].append(name)
    leaves, saved = {}, {}
    for name in sorted(members, key=len, reverse=True):
        own = (len(members[name]) - 1) * (len(name[-1][1].encode()) if name else 0)
        leaves[name] = sum(leaves[n] for n in children[name]) if children[name] else 1
        saved[name] = own + sum(saved[n] for n in children[name])
    rows = []
    for name, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(turns[c]) == len(name))
        parent = min(members[name[:-1]]) if name else None
        rows.append(
            (min(own), len(name), parent, len(own), len(children[name]), leaves[name], saved[name], hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(rows, key=repr)


@pytest.fixture
def random_rows():
    rng = random.Random(5)
    rows = []
    for c in range(60):
        for turn in range(rng.randrange(1, 14)):
            rows.append((c, turn, rng.choice("ua"), rng.choice(["yes", "nö", ""])))
    rng.shuffle(rows)
    return rows


def test_query_against_plain_code(spark, small):
    found = rows_of(queries.op11_prefix_trie(spark, small))
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found == plain_trie(plain_rebuilt(plain_turns(rows)))


@pytest.mark.parametrize("band", [2, 3, 16])
def test_bands(spark, random_rows, band):
    """Every band height gives the same totals; a band of two needs several rounds."""
    found = T.trie(*T.as_they_are(*T.ordered(conversations(spark, random_rows))), band=band)
    assert rows_of(found) == plain_trie(plain_turns(random_rows))


def test_shared_heads(spark, random_rows):
    rows = random_rows + [(c, t, "u", "yes") for c in (-7, -5, 101, 103, 105, 10**12) for t in range(5)]
    assert rows_of(T.rebuilt_trie(conversations(spark, rows))) == plain_trie(plain_rebuilt(plain_turns(rows)))


def test_odd_rows(spark):
    rows = [
        (None, 0, "u", "nobody"), (1, None, "u", "first"), (1, None, "u", "first"), (1, 3, None, None), (1, 3, "", ""),
        (1, 3, "u", "tie"), (2, 0, "u", "a"), (2, 0, "u", "a"), (2, 0, "a", "u"), (3, 0, "ua", ""), (4, 0, "u", "a"), (4, 1, None, "long " * 50_000),
    ]
    frame = conversations(spark, rows)
    odd = frame.withColumns({c: F.lit(7) for c in ("depth", "k1", "pos", "n", "bytes", "part", "place", "last", "leaves")})
    for df in (frame, odd):
        assert rows_of(T.trie(*T.as_they_are(*T.ordered(df)))) == plain_trie(plain_turns(rows))
        assert rows_of(T.rebuilt_trie(df)) == plain_trie(plain_rebuilt(plain_turns(rows)))
    assert T.rebuilt_trie(conversations(spark, [])).count() == 0


def test_a_long_conversation_and_many_copies(spark, monkeypatch):
    """One conversation with a third of all rows, copies, one hot first turn, blocks and chunks that split."""
    monkeypatch.setattr(T, "BLOCK_TURNS", 7)
    monkeypatch.setattr(T, "HEAVY", 5)
    rows = [(3, t, "u", "same") for t in range(300)] + [(4, t, "u", "same") for t in range(90)]
    rows += [(c, t, "u", f"{t}") for c in range(1000, 1300) for t in range(2)]
    rows += [(c, t, "u", "hot" if t == 0 else f"{c}") for c in range(2000, 2100) for t in range(2)]
    found = T.trie(*T.as_they_are(*T.ordered(conversations(spark, rows).repartition(5))))
    assert rows_of(found) == plain_trie(plain_turns(rows))


def test_ranges_number_long_conversations(spark):
    """Numbers go on where a range ends, whatever the ranges."""
    rows = [(7, t % 40, "u", str(t % 3)) for t in range(400)] + [(8, 0, "u", "x")] * 50
    turns, parts = T.ordered(conversations(spark, rows).repartition(3))
    found = turns.collect()
    assert sorted(r.pos for r in found if r.conv_id == 7) == list(range(1, 401))
    assert sorted(r.pos for r in found if r.conv_id == 8) == list(range(1, 51))
    assert parts.agg(F.sum("n")).first()[0] == 450
