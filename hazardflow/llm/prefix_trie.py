"""Trie of the conversations of a table: each distinct sequence of first turns is a node, with totals of its subtree.

A prefix is named by its depth and the exclusive-or of 128 bits per turn (from SHA-256 of role and text, and the place),
so names come from running aggregates and texts are read once. Subtree totals go through bands of fixed height:
inside a band the values of a path's own nodes reach their ancestors along one of their conversations, added up on
the way; band roots, which then have the totals of their band, form a trie of a fraction of the height that is solved
alike; and their completed totals enter the band above as one more value. A path is never followed beyond its band, and
rounds grow with the logarithm of the depth.

No conversation, node or family is gathered: turns are numbered in ranges of the sorted table, prefixes are named in
blocks of turns, copies are added up inside tasks, and the parent of many children is looked up by broadcast (only a
bounded number can have that many). Members of a node are joined in chunks; a task streams over a node's chunks.

Odd rows: null conversation ids are left out; null roles and texts are empty; a null turn comes first; equal turn numbers
are ordered by the digest of role and text; repeated rows are turns of their own; an empty table has no nodes; extra
columns are ignored, whatever their names. Remainders of negative ids are negative, as in SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hazardflow.llm.storage import stored

BAND = 16
# Turns of one conversation that are named together in a task.
BLOCK_TURNS = 1024
# Members of a node are joined by ranges of 2^8 ids.
CHUNK_BITS = 8
# Parents of at least a 1/HEAVY part of all nodes number HEAVY at most.
HEAVY = 1000
# Heads are shared inside groups of so many ids, up to so many turns.
FAMILY, LONGEST_HEAD = 5, 8
KEY = ["depth", "k1", "k2"]
NUMBERED = "conv_id long, part int, at long, digest binary, bytes long"


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a role and a text; the length of the role keeps the two apart."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each conversation of a sorted partition."""
    last, count = None, 0
    for batch in batches:
        conv = batch.column("conv_id").to_numpy()
        if not len(conv):
            continue
        starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        index = np.arange(len(conv))
        at = index - np.repeat(starts, np.diff(np.append(starts, len(conv)))) + 1
        if conv[0] == last:
            at[: starts[1] if len(starts) > 1 else None] += count
        last, count = conv[-1], int(at[-1])
        columns = [batch.column("conv_id"), batch.column("part"), pa.array(at), batch.column("digest"), batch.column("bytes")]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "at", "digest", "bytes"])


def ordered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns (conv_id, part, pos, digest, bytes), and the number of turns of each (conv_id, part).

    A conversation of any length spreads over ranges of the sorted table (``part``).
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    narrow = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        turn_digest(role, text).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
        # Equal rows are interchangeable; their places in the input let ranges split them.
        F.monotonically_increasing_id().alias("place"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("place")]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stored(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_number, NUMBERED), "turns")
    parts = stored(numbered.groupBy("conv_id", "part").agg(F.max("at").alias("n")), "turn-parts")
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # Only the first conversation of a part can have begun before it, so there is at most one row for each part.
    carried = parts.select("conv_id", "part", F.sum("n").over(earlier).alias("carry")).where("carry is not null")
    pos = F.col("at") + F.coalesce(F.col("carry"), F.lit(0))
    turns = numbered.join(F.broadcast(carried), ["conv_id", "part"], "left")
    return turns.select("conv_id", "part", pos.alias("pos"), "digest", "bytes"), parts


def as_they_are(turns: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps and lengths (see ``named``) of conversations as the table has them."""
    lengths = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"))
    ends = parts.select("conv_id", "part").join(lengths, "conv_id")
    steps = turns.join(ends, ["conv_id", "part"])
    last = F.col("pos") == F.col("n_turns")
    return steps.select("conv_id", F.col("pos").alias("depth"), "digest", "bytes", last.alias("last")), lengths


def with_shared_heads(turns: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps and lengths (see ``named``) after the first h turns were taken from the first id of the family of five.

    h is the CRC-32 of the decimal id modulo nine; the conversation's own first h turns give way.
    """
    head = F.when(F.col("pos") <= LONGEST_HEAD, F.struct("pos", "digest", "bytes"))
    heads = turns.groupBy("conv_id").agg(F.max("pos").alias("n"), F.collect_list(head).alias("head"))
    heads = stored(heads.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % (LONGEST_HEAD + 1)), "heads")
    first = heads.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("head").alias("base_head"))
    mine = heads.select("conv_id", "n", "h", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    plan = mine.join(first, "base", "left").select(
        "conv_id",
        "h",
        F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"),
        F.filter("base_head", lambda t: t["pos"] <= F.col("h")).alias("base_head"),
        F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("kept"),
    )
    plan = stored(plan.withColumn("n_turns", F.col("taken") + F.col("kept")), "head-plan")
    taken = plan.select("conv_id", "n_turns", F.explode("base_head").alias("t")).select(
        "conv_id", F.col("t.pos").alias("depth"), "t.digest", "t.bytes", (F.col("t.pos") == F.col("n_turns")).alias("last")
    )
    # By conversation and part, so that a long conversation is not one key.
    shift = parts.select("conv_id", "part").join(plan.where("kept > 0").select("conv_id", "h", "taken", "n_turns"), "conv_id")
    depth = F.col("pos") - F.col("h") + F.col("taken")
    own = turns.join(shift, ["conv_id", "part"]).where("pos > h").select(
        "conv_id", depth.alias("depth"), "digest", "bytes", (depth == F.col("n_turns")).alias("last")
    )
    return taken.unionByName(own), plan.select("conv_id", "n_turns")


def named(steps: DataFrame, lengths: DataFrame) -> DataFrame:
    """The prefixes of every conversation, the empty one included: conv_id, depth, name, parent's name, bytes, last.

    ``steps`` has conv_id, depth from 1, digest, bytes and whether it is the last turn; ``lengths`` has every
    conv_id, those without turns included, and n_turns.
    """
    block = ((F.col("depth") - 1) / BLOCK_TURNS).cast("long")
    marked = steps.select(
        "conv_id", "depth", block.alias("block"), "bytes", "last",
        F.xxhash64("digest", "depth").alias("x1"), F.xxhash64("depth", "digest").alias("x2"),
    )
    so_far = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    inside = marked.withColumns({f"y{i}": F.bit_xor(f"x{i}").over(so_far) for i in (1, 2)})
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = marked.groupBy("conv_id", "block").agg(*[F.bit_xor(f"x{i}").alias(f"b{i}") for i in (1, 2)])
    carried = blocks.select("conv_id", "block", *[F.bit_xor(f"b{i}").over(earlier).alias(f"c{i}") for i in (1, 2)])
    names = {f"k{i}": F.col(f"y{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0))) for i in (1, 2)}
    parents = {f"p{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")) for i in (1, 2)}
    below = inside.join(carried, ["conv_id", "block"]).withColumns(names).withColumns(parents)
    columns = ["conv_id", "depth", "k1", "k2", "p1", "p2", "bytes", "last"]
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = lengths.select(
        "conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"),
        zero.alias("bytes"), (F.col("n_turns") == 0).alias("last"),
    )
    return stored(below.select(columns).unionByName(roots), "paths")


def distinct_nodes(paths: DataFrame) -> DataFrame:
    """One row per node: name, parent's name, smallest member, numbers of members and children, bytes of its last text."""
    nodes = paths.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.max("bytes").alias("bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    )
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = nodes.where("depth > 0").groupBy(*parent).agg(F.count("*").alias("n_children"))
    return stored(nodes.join(children, KEY, "left").fillna(0, ["n_children"]), "nodes")


def _within(paths: DataFrame, values: DataFrame, entering: DataFrame | None, band: int) -> DataFrame:
    """Sums of the values below each node inside its band, and of those that enter the band from below.

    Values lie on the path of the smallest member of their node. Each path adds them up from its lower end of the
    band, so that an ancestor gets one row of a path, not one of each node.
    """
    none = F.lit(None).cast("long")
    of_band = (F.col("depth") / band).cast("long")
    names = ["conv_id", "band", "depth", "k1", "k2", "leaves", "saved", "named"]
    rows = paths.select("conv_id", of_band.alias("band"), "depth", "k1", "k2", none.alias("leaves"), none.alias("saved"), F.lit(1).alias("named"))
    parts = [values.withColumn("band", of_band)]
    if entering is not None:
        parts.append(entering.withColumn("depth", (F.col("band") + 1) * band))
    for part in parts:
        rows = rows.unionByName(part.withColumns({"k1": none, "k2": none, "named": F.lit(0)}).select(names))
    below = W.partitionBy("conv_id", "band").orderBy(F.desc("depth"), "named").rowsBetween(W.unboundedPreceding, 0)
    sums = rows.withColumns({c: F.sum(c).over(below) for c in ("leaves", "saved")}).where("named = 1 and leaves is not null")
    return sums.groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def subtree_totals(paths: DataFrame, nodes: DataFrame, values: DataFrame, deepest: int, band: int = BAND) -> DataFrame:
    """Sums of ``values`` (conv_id, depth, leaves, saved) over each node's subtree, by name.

    ``nodes`` gives the smallest member of each name; a value lies on that member's path.
    """
    if deepest < band:
        return _within(paths, values, None, band)
    of_band = (F.col("depth") / band).cast("long").alias("depth")
    own = values.groupBy("conv_id", of_band).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    roots = nodes.where(F.col("depth") % band == 0).select(of_band, "k1", "k2", "conv_id")
    root_paths = paths.where(F.col("depth") % band == 0).select("conv_id", of_band, "k1", "k2")
    of_roots = root_paths.join(own, ["conv_id", "depth"]).groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    # Written, since the next round reads them more than once.
    root_values = stored(of_roots.join(roots, KEY).select("conv_id", "depth", "leaves", "saved"), "band-values")
    root_paths = stored(root_paths.join(root_values.select("conv_id").distinct(), "conv_id", "left_semi"), "band-paths")
    complete = subtree_totals(root_paths, roots, root_values, deepest // band, band)
    entering = complete.where("depth > 0").join(roots, KEY).select("conv_id", (F.col("depth") - 1).alias("band"), "leaves", "saved")
    return _within(paths, values, entering, band)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each node's members from its chunks, which come in order."""
    names = [*KEY, "ends_sha256"]
    last, state = None, None
    for batch in batches:
        out = []
        for *key, text in zip(*[batch.column(c).to_pylist() for c in (*KEY, "members")]):
            if key == last:
                state.update(b",")
            else:
                if state:
                    out.append((*last, state.hexdigest()))
                last, state = key, hashlib.sha256()
            state.update(text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*last, state.hexdigest())], names)


def end_digests(paths: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end at each node, ascending and joined by commas."""
    chunk = F.shiftright("conv_id", CHUNK_BITS).alias("chunk")
    members = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    chunks = paths.where("last").groupBy(*KEY, chunk).agg(members.alias("members"))
    in_order = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk")
    return in_order.mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Add the parent's smallest member; parents with many children are joined by broadcast."""
    parent = nodes.select(F.col("depth") + 1, "k1", "k2", "conv_id").toDF("depth", "p1", "p2", "parent_conv_id")
    many = F.col("n_children") * HEAVY >= nodes.count()
    on = ["depth", "p1", "p2"]
    heavy = nodes.where(many).select(F.col("depth") + 1, "k1", "k2", "conv_id").toDF(*on, "parent_conv_id")
    found = nodes.join(F.broadcast(heavy), on, "left")
    rest = found.where("parent_conv_id is null").drop("parent_conv_id").join(parent, on, "left")
    return found.where("parent_conv_id is not null").unionByName(rest)


def trie(steps: DataFrame, lengths: DataFrame, band: int = BAND) -> DataFrame:
    """One row per node, named by its smallest member and depth (``named`` says what is read).

    parent_conv_id; n_convs (members); n_children; n_leaves (childless nodes of the subtree); saved_tokens (over the
    subtree, members but one times the bytes of the last text); ends_sha256 (of the members that end here).
    """
    paths = named(steps, lengths)
    nodes = distinct_nodes(paths)
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    values = nodes.select(
        "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    totals = subtree_totals(paths, nodes, values, deepest, band)
    full = _with_parents(nodes).join(totals, KEY).join(end_digests(paths), KEY, "left")
    empty = hashlib.sha256().hexdigest()
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations whose heads are shared inside families."""
    return trie(*with_shared_heads(*ordered(conversations)))


def _crc32(text: str) -> str:
    """CRC-32 of ASCII digits in SQL: eight shifts for each byte."""
    shift = "xor(c >> 1, 3988292384 * (c & 1))"
    byte = f"list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, _: {shift})"
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda crc, b: {byte}), 4294967295)"


ORACLE = f"""
WITH t AS (
  SELECT conv_id, digest, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos
  FROM (SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes,
               sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
        FROM conversations WHERE conv_id IS NOT NULL)),
c AS (
  SELECT conv_id, count(*) AS n, {_crc32("conv_id::VARCHAR")} % {LONGEST_HEAD + 1} AS h, conv_id - conv_id % {FAMILY} AS base
  FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, t.pos AS depth, digest, bytes FROM c JOIN t ON t.conv_id = base AND t.pos <= h
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.n, 0)), digest, bytes
  FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN c AS b ON b.conv_id = c.base),
p AS (
  SELECT conv_id, depth, bytes, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS name FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (
  SELECT depth, name, left(name, 64 * (depth - 1)) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes
  FROM p GROUP BY depth, name),
k AS (SELECT parent AS name, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent),
v AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children
  FROM n LEFT JOIN k USING (name)),
s AS (
  SELECT p.name, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs - 1) * v.bytes)::BIGINT AS saved_tokens
  FROM v JOIN p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.name),
e AS (
  SELECT name, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, arg_max(name, depth) AS name FROM p GROUP BY conv_id) GROUP BY name)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens,
       coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM v JOIN s USING (name) LEFT JOIN e USING (name) LEFT JOIN n AS u ON v.depth > 0 AND u.name = v.parent
"""
