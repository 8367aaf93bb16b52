"""Near-duplicate documents: minima of universal hashes, bands, signature verification, exact confirmation.

1. Every text becomes its set of word shingles, a digest of that set and a signature of ``MINIMA`` minima.
   Texts with equal sets are one node, named by the least document id.
2. Nodes that agree in a band share a bucket. A bucket is never expanded into pairs: its members are compared with
   a center: the member with the most neighbours in all its buckets, which in a group of edited copies is the one
   closest to the original.
3. Pairs whose signatures agree enough are confirmed on full sets, around one center at a time, in groups of bounded size.
4. Components of the confirmed links. Where a bucket still spans several components, its members outside the most
   frequent one meet all others in blocks, in which signatures and then full sets are compared; only links leave a block.
   So no link that the bands offer is lost, and a bucket whose members are one component costs no more.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from hazardflow.llm.components import components
from hazardflow.llm.encoding import text_runs
from hazardflow.llm.shingles import _mix, common, shingle_sets
from hazardflow.llm.storage import stored

MINIMA = 192
PERCENT = 85
# Signatures of a pair at the limit agree in fewer places than are asked for with at most this probability.
LOSS = 5e-9
# Bits of the set of wanted ids by which texts are picked before they are shuffled. However full it is, no wanted text is lost.
ID_BITS = 1 << 27
# Shingles that are compared with one center in a group; members of a bucket in one block.
GROUP_SHINGLES = 20_000
BLOCK = 256

_A = _mix(np.arange(1, MINIMA + 1, dtype=np.uint64)) | np.uint64(1)
_B = _mix(np.arange(1001, MINIMA + 1001, dtype=np.uint64))


def rows_of_band(percent: int) -> int:
    """Minima in a band. A pair at the limit shares none of the ``MINIMA // rows`` bands with a probability of 3e-7, at 0.85 as at 0.80."""
    return 6 if percent >= 85 else 5


@functools.lru_cache
def least_agreement(percent: int) -> int:
    """The most places that can be asked for if a pair at the limit may miss them with a probability of ``LOSS``."""
    p, below, places = percent / 100, 0.0, 0
    while places < MINIMA and below + (at := math.comb(MINIMA, places) * p**places * (1 - p) ** (MINIMA - places)) <= LOSS:
        below, places = below + at, places + 1
    return places


def signature(shingles: np.ndarray) -> np.ndarray:
    """``MINIMA`` minima of a set under multiply-add hashes, reduced to 16 evenly spread bits each."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 256):  # stays in the processor's cache
        np.minimum(least, (shingles[i : i + 256, None] * _A + _B).min(axis=0), out=least)
    return (_mix(least) >> np.uint64(48)).astype(np.uint16)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """One row per document: number of shingles, digest of the set, signature (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_runs(batches):
            sets = shingle_sets(texts, words)
            digests = [(int(s.sum(dtype=np.uint64)), int(_mix(s).sum(dtype=np.uint64))) for s in sets]
            signed = [np.array(c, dtype=np.uint64).view(np.int64) for c in zip(*digests)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(signed[0]), pa.array(signed[1]),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "n", "h1", "h2", "sig"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sig binary")


def signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, MINIMA)


_FOLD = _mix(np.arange(5001, MINIMA + 5001, dtype=np.uint64)) | np.uint64(1)
_SALT = _mix(np.arange(9001, MINIMA + 9001, dtype=np.uint64))


def banded(places: np.ndarray, rows: int) -> np.ndarray:
    """Values per place of signatures, dealt to the bands; places that fill no band are left out."""
    bands = MINIMA // rows
    return places[:, : bands * rows].reshape(-1, bands, rows)


def band_keys(sigs: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band of each signature; it holds the band's number and minima."""
    minima = banded(sigs.astype(np.uint64).reshape(-1, MINIMA), rows)
    keys = (_mix(minima + np.uint64(1)) * _FOLD[:rows]).sum(axis=2, dtype=np.uint64)
    return _mix(keys + _SALT[: keys.shape[1]]).view(np.int64)


def band_rows(nodes: DataFrame, rows: int) -> DataFrame:
    """``key, node``: one row per node and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(signatures(batch.column("sig")), rows)
                nodes_ = np.repeat(batch.column("node").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1)), pa.array(nodes_)], ["key", "node"]
                )

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def star_pairs(members: DataFrame) -> DataFrame:
    """Distinct ``center, node`` pairs: members of each bucket with the one that has the most neighbours."""
    popular = F.max(F.struct("neighbours", "node")).getField("node")
    buckets = members.groupBy("key").agg(popular.alias("center"))
    return members.join(buckets, "key").where("node <> center").select("center", "node").distinct()


def agreeing(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures agree in ``least_agreement`` places or more and whose set sizes allow a link."""
    least = least_agreement(percent)
    sides = pairs.join(nodes.select("node", "n", "sig"), "node").join(
        nodes.select(F.col("node").alias("center"), F.col("n").alias("center_n"), F.col("sig").alias("center_sig")), "center"
    )
    sized = sides.where(f"100 * least(n, center_n) >= {percent} * greatest(n, center_n)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = signatures(batch.column("sig")) == signatures(batch.column("center_sig"))
                kept = pa.array(np.count_nonzero(same, axis=1) >= least)
                yield batch.select(["center", "node", "n"]).filter(kept)

    return sized.select("center", "node", "n", "sig", "center_sig").mapInArrow(run, "center long, node long, n long")


def picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is in ``ids``, and some others: those that share a bit with a wanted id.

    The set is a table of at most ``ID_BITS / 64`` numbers, so it can be sent to all tasks at any scale.
    """
    spark = docs.sparkSession
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS))
    words = ids.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))).alias("bits")
    )
    found = words.toArrow()
    table = np.zeros(ID_BITS // 64, dtype=np.int64)
    table[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    sent = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column("b").to_numpy()
            yield batch.select(["doc_id", "text"]).filter(pa.array((sent.value[b >> 6] >> (b & 63) & 1).astype(bool)))

    return docs.select("doc_id", "text", bit.alias("b")).mapInArrow(run, "doc_id long, text string")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``u, v`` among ``center, node, n`` pairs: full sets meet around their center.

    The pairs should be a written table, since their totals are needed first.

    A center with many members gets several groups, each with a copy of the center's text and members of
    ``GROUP_SHINGLES`` shingles or one larger member.
    """
    totals = pairs.groupBy("center").agg(F.ceil(F.sum("n") / GROUP_SHINGLES).alias("groups"))
    members = pairs.join(totals, "center").select(
        F.col("node").alias("doc_id"), "center", F.pmod(F.xxhash64("node"), "groups").alias("part"), F.lit(1).alias("role")
    )
    heads = members.select(F.col("center").alias("doc_id"), "center", "part", F.lit(0).alias("role")).distinct()
    wanted = members.unionByName(heads)
    ids = pairs.select(F.explode(F.array("center", "node")).alias("doc_id"))
    placed = (
        wanted.join(picked(docs, ids), "doc_id")
        .select("doc_id", "text", "center", "part", "role")
        .repartition("center", "part")
        .sortWithinPartitions("center", "part", "role")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: tuple = (None, None, None)
        for batch in batches:
            extra = list(zip(*(batch.column(c).to_pylist() for c in ("center", "part", "role"))))
            at, links = 0, []
            for ids, texts in text_runs([batch]):
                for doc, own in zip(ids, shingle_sets(texts, words)):
                    center, part, role = extra[at]
                    at += 1
                    if role == 0:
                        head = (center, part, own)
                    elif head[:2] == (center, part):
                        both = common(own, head[2])
                        if 100 * both >= percent * (len(own) + len(head[2]) - both):
                            links.append((center, doc))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["u", "v"])

    return placed.mapInArrow(run, "u long, v long")


def spanning(bands: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, node, comp`` of the buckets that hold members of several components."""
    named = bands.join(labels, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("comp")
    )
    mixed = named.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key")
    return named.join(mixed, "key")


def block_links(members: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``u, v`` across components of each bucket.

    The members outside the bucket's most frequent component meet all members, ``BLOCK`` of them at a time; ``part`` spreads a
    large bucket. Signatures pick the pairs whose full sets are compared. A pair that shares several buckets is compared
    in that of its first common band. Only links leave a block.
    """
    counts = members.groupBy("key", "comp").agg(F.count("*").alias("c"))
    main = counts.groupBy("key").agg(
        F.max(F.struct("c", "comp")).getField("comp").alias("main"), F.ceil(F.sum("c") / BLOCK).alias("parts")
    )
    texts = picked(docs, members.select(F.col("node").alias("doc_id"))).withColumnRenamed("doc_id", "node")
    full = members.join(main, "key").join(nodes.select("node", "n", "sig"), "node").join(texts, "node")
    own = F.array(F.struct(F.pmod(F.xxhash64("node"), "parts").alias("part"), F.lit(0).alias("role")))
    probes = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.lit(1).alias("role")))
    places = F.when(F.col("comp") != F.col("main"), F.concat(own, probes)).otherwise(own)
    placed = full.select("key", F.explode(places).alias("p"), "node", "comp", "n", "sig", "text")
    dealt = (
        placed.select("node", "text", "key", "p.part", "p.role", "comp", "n", "sig")
        .repartition("key", "part")
        .sortWithinPartitions("key", "part", "role")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, block, stacked = None, [], None
        for batch in batches:
            links, at = [], 0
            sigs = signatures(batch.column("sig")) if batch.num_rows else []
            extra = list(zip(*(batch.column(c).to_pylist() for c in ("key", "part", "role", "comp", "n"))))
            for ids, runs in text_runs([batch]):
                for node, shingles in zip(ids, shingle_sets(runs, words)):
                    (key, part, role, comp, n), sig = extra[at], sigs[at]
                    at += 1
                    if place != (key, part):
                        place, block, stacked = (key, part), [], None
                    if role == 0:
                        block.append((node, comp, n, sig, shingles))
                        continue
                    if stacked is None and block:
                        stacked = [np.array(c) for c in zip(*(b[:4] for b in block))]
                    if block:
                        links += probe_links(node, comp, n, sig, shingles, key, stacked, block, percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def probe_links(
    node: int, comp: int, n: int, sig: np.ndarray, shingles: np.ndarray, key: int, stacked: list, block: list, percent: int
) -> list[tuple[int, int]]:
    """Links of one node to members of a block in other components, one for each component."""
    sizes = 100 * np.minimum(stacked[2], n) >= percent * np.maximum(stacked[2], n)
    same = stacked[3] == sig
    alike = np.flatnonzero((stacked[1] != comp) & sizes & (same.sum(axis=1) >= least_agreement(percent)))
    if not len(alike):
        return []
    rows = rows_of_band(percent)
    band = int(np.flatnonzero(band_keys(sig, rows)[0] == key)[0])
    first = banded(same[alike], rows).all(axis=2).argmax(axis=1) == band
    links, reached = [], set()
    for i in alike[first].tolist():
        other, other_comp, _, _, own = block[i]
        if other_comp not in reached:
            both = common(own, shingles)
            if 100 * both >= percent * (len(own) + len(shingles) - both):
                links.append((other, node))
                reached.add(other_comp)
    return links


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = PERCENT
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    Two documents are linked if their sets of ``words``-word shingles have an intersection of at least ``percent`` hundredths
    of their union (80 or more). A component is named by its least id and keeps that
    document. Texts that are null or have no words are linked with nothing. Rows without an id are linked with nothing
    and kept. Repeated rows of one id share a component.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = stored(sketch(docs, words), "sketches")
    own = sketches.select("doc_id", "n", "h1", "h2")
    sets = own.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("node"))
    members = stored(
        own.join(sets, ["n", "h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node")),
        "members",
    )
    heads = members.where("node = doc_id and n_shingles > 0").select("node")
    nodes = stored(
        sketches.withColumnRenamed("doc_id", "node").join(heads, "node", "left_semi").select("node", "n", "sig")
        .dropDuplicates(["node"]),
        "nodes",
    )
    bands = band_rows(nodes, rows_of_band(percent))
    texts = docs.where("doc_id is not null")
    shared = bands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    common_bands = bands.join(shared, "key")
    neighbours = common_bands.groupBy("node").agg(F.sum("c").alias("neighbours"))
    bands = stored(common_bands.select("key", "node").join(neighbours, "node"), "bands")

    pairs = stored(agreeing(star_pairs(bands), nodes, percent), "pairs")
    links = stored(confirmed(pairs, texts, words, percent), "links")
    labels = stored(components(links), "labels")
    left = stored(spanning(bands, labels), "spanning")
    if not left.isEmpty():
        more = stored(block_links(left, nodes, texts, words, percent), "links")
        known = labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
        labels = stored(components(known.unionByName(more)), "labels")

    named = members.join(labels, "node", "left")
    component = F.coalesce("component", "node")
    return named.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each group of near duplicates at ``percent``, with all its columns.

    Of rows that share an id one stays; rows without an id all stay.
    """
    # Names of its own that no column of the documents has.
    longest = "_" * (1 + max(map(len, docs.columns)))
    kept_id, number = f"{longest}kept", f"{longest}n"
    kept = near_duplicates(docs, id_col, text_col, percent=percent).where("kept and doc_id is not null").select(F.col("doc_id").alias(kept_id)).distinct()
    chosen = docs.join(kept, F.col(id_col).cast("long") == F.col(kept_id))
    first = W.partitionBy(kept_id).orderBy(F.xxhash64(text_col))
    once = chosen.withColumn(number, F.row_number().over(first)).where(F.col(number) == 1).select(docs.columns)
    return once.unionByName(docs.where(F.col(id_col).isNull()))
