"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

1. Every token has a fixed sparse index vector, given by its hash. The vector of a token is the sum of the index vectors of
   its neighbours over all documents, so it is gathered in one pass and added up across tasks. Tokens are hashed to
   ``VOCABULARY`` rows: the table has a fixed size, whatever the corpus.
2. A document is pooled to the mean and spread of its token vectors, the mean over its distinct tokens, and two counts.
3. A network with one hidden layer is trained in numpy on at most ``MAX_TRAIN`` labelled documents; a part of them,
   kept out of the fit, sets the temperature that makes its probabilities fit the observed rates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hazardflow.llm.encoding import text_runs
from hazardflow.llm.shingles import _BASE, _mix, _power
from hazardflow.llm.storage import stored

VOCABULARY = 1 << 14
DIMS = 32
NONZEROS = 2
NEIGHBOURS = (1, 2)
# Labelled rows the network is fitted on: the least by a hash of the id. All else covers all documents.
MAX_TRAIN = 20_000
HIDDEN = 32
EPOCHS = 30
THRESHOLD = 0.3
FEATURES = 3 * DIMS + 2
CHUNK_ROWS = 256
SUM_PARTS = 16

# Classes of bytes; a token is a run of one class. Bytes of other letters count as lower case.
_CLASS = np.full(256, 1, dtype=np.int8)
_CLASS[128:] = 2
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[[32, *range(9, 14)]] = 0
_VALUES = _mix(np.arange(1, 257, dtype=np.uint64))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zeros of every token's index vector."""
    bits = _mix(np.arange(VOCABULARY * NONZEROS, dtype=np.uint64)).reshape(VOCABULARY, NONZEROS)
    return (bits % np.uint64(DIMS)).astype(np.int64), np.where(bits >> np.uint64(63), 1.0, -1.0)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed tokens of all texts in order, and where each text's tokens begin (one more entry: the end)."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(b) + 1 for b in encoded])
    data = np.frombuffer(b"\n".join([*encoded, b""]), dtype=np.uint8)
    kind = _CLASS[data]
    begin = np.flatnonzero(np.diff(kind, prepend=0) != 0)
    begin = begin[kind[begin] > 0]
    change = np.append(np.flatnonzero(np.diff(kind) != 0) + 1, len(data))
    end = change[np.searchsorted(change, begin, side="right")]
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * _power("up", _BASE, len(data)), out=prefix[1:])
    inverse = pow(_BASE, -1, 1 << 64)
    hashes = _mix((prefix[end] - prefix[begin]) * _power("down", inverse, len(data))[begin])
    return (hashes % np.uint64(VOCABULARY)).astype(np.int64), np.concatenate([[0], np.searchsorted(begin, ends)])


def context_sums(found: np.ndarray, at: np.ndarray, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sum of the neighbours' index vectors for every token; neighbours stand in the same text."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    sums = np.zeros(VOCABULARY * DIMS)
    for k in NEIGHBOURS:
        same = text[k:] == text[:-k]
        left, right = found[:-k][same], found[k:][same]
        for a, b in ((left, right), (right, left)):
            for j in range(NONZEROS):
                sums += np.bincount(a * DIMS + places[b, j], weights=signs[b, j], minlength=len(sums))
    return sums.reshape(VOCABULARY, DIMS)


def _summed(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Add up equal keys' blocks of vectors, one at a time; a task holds one sum, however many blocks there are."""
    dealt = chunks.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.RecordBatch.from_pydict(
                {"chunk": pa.array([here[0]], pa.int32()), "part": pa.array([here[-1]], pa.int32()), "sums": pa.array([total.tobytes()])}
            )

        here, total = None, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*keys, "sums"))):
                if here != row[:-1]:
                    if here is not None:
                        yield out()
                    here, total = row[:-1], 0
                total = total + np.frombuffer(row[-1])
        if here is not None:
            yield out()

    return dealt.mapInArrow(run, "chunk int, part int, sums binary")


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of token vectors, ``VOCABULARY`` by ``DIMS``, from all documents; each row has length 1 or 0."""
    places, signs = index_vectors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((VOCABULARY, DIMS))
        for _, texts in text_runs(batches):
            total += context_sums(*tokens(texts), places, signs)
        for c in range(VOCABULARY // CHUNK_ROWS):
            own = total[c * CHUNK_ROWS : (c + 1) * CHUNK_ROWS]
            if own.any():
                yield pa.RecordBatch.from_pydict(
                    {
                        "chunk": pa.array([c], pa.int32()),
                        "part": pa.array([TaskContext.get().partitionId() % SUM_PARTS], pa.int32()),
                        "sums": pa.array([own.tobytes()]),
                    }
                )

    parts = _summed(docs.mapInArrow(run, "chunk int, part int, sums binary"), ["chunk", "part"])
    whole = _summed(parts, ["chunk"])
    table = np.zeros((VOCABULARY, DIMS))
    for row in whole.collect():  # VOCABULARY / CHUNK_ROWS rows, 4 MB in all
        table[row["chunk"] * CHUNK_ROWS : (row["chunk"] + 1) * CHUNK_ROWS] = np.frombuffer(row["sums"]).reshape(-1, DIMS)
    length = np.sqrt((table * table).sum(axis=1, keepdims=True))
    return (table / np.where(length > 0, length, 1)).astype(np.float32)


def pooled(found: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features of one document; a text without tokens has zeros."""
    if not len(found):
        return np.zeros(FEATURES, dtype=np.float32)
    kinds, counts = np.unique(found, return_counts=True)
    own = vectors[kinds]
    share = (counts / len(found)).astype(np.float32)
    mean = share @ own
    spread = np.sqrt(np.maximum(share @ (own * own) - mean * mean, 0))
    sizes = [np.log1p(len(found)), len(kinds) / len(found)]
    return np.concatenate([mean, spread, own.mean(axis=0), sizes]).astype(np.float32)


def features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """``doc_id, x``: pooled features of every whole text. The table of vectors is 2 MB, sent once per executor."""
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_runs(batches):
            found, at = tokens(texts)
            x = [pooled(found[a:b], sent.value).tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(x, pa.binary())], ["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id long, x binary")


class Network:
    """Standardised inputs, one hidden layer, one logistic output with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.center, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        own = np.arange(len(x)) % 10 == 0 if len(x) >= 50 else np.zeros(len(x), dtype=bool)
        z = self._standard(x)
        fit_x, fit_y = z[~own], y[~own]
        self.weights = [
            rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden),
            rng.normal(0, hidden**-0.5, hidden), np.zeros(1),
        ]
        self.temperature = 1.0
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(fit_x))
            for a in range(0, len(order), 64):
                some = order[a : a + 64]
                step += 1
                for i, g in enumerate(self._gradients(fit_x[some], fit_y[some])):
                    m, v = moments[i]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    rate = 2e-3 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    self.weights[i] = self.weights[i] - rate * m / (np.sqrt(v) + 1e-8)
        if own.any():
            logits, labels = self._logits(z[own]), y[own]
            tried = np.exp(np.linspace(-1.5, 1.5, 61))
            losses = [np.logaddexp(0, np.where(labels > 0, -1, 1) * logits / t).mean() for t in tried]
            self.temperature = float(tried[int(np.argmin(losses))])

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -10, 10)

    def _logits(self, z: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(z @ a + b) @ c + d[0]

    def _gradients(self, z: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        a, b, c, d = self.weights
        h = np.tanh(z @ a + b)
        e = (1 / (1 + np.exp(-np.clip(h @ c + d[0], -30, 30))) - y) / len(y)
        back = np.outer(e, c) * (1 - h * h)
        return [z.T @ back + 1e-4 * a, back.sum(axis=0), h.T @ e + 1e-4 * c, np.array([e.sum()])]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits(self._standard(x)) / self.temperature, -500, 500)))


def held_out(doc_id: Column | str) -> Column:
    """Rows whose labels are never learned from; a row without an id is not one of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=np.float32).reshape(-1, FEATURES).astype(np.float64)


def train(pooled_docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Network | None:
    """Fit on labelled documents that are not held out; None without any."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("y"))
    usable = pooled_docs.join(known, "doc_id").where(~held_out("doc_id"))
    rows = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_train).select("x", "y").toArrow()
    if not rows.num_rows:
        return None
    return Network(matrix(rows.column("x").to_pylist()), rows.column("y").to_numpy().astype(np.float64))


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _probabilities(network: Network | None, x: list[bytes]) -> np.ndarray:
    return network.probabilities(matrix(x)) if network else np.full(len(x), 0.5)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    ``labels`` has ``doc_id`` and ``quality`` (1 is good); rows with nulls teach nothing, repeated ids count once. A null
    text is an empty one and gets the score of a text without tokens. Repeated documents get equal scores. Without
    labelled rows every score is 0.5.
    """
    plain = _plain(docs, id_col, text_col)
    pooled_docs = stored(features(plain, word_vectors(plain)), "features")
    network = train(pooled_docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = _probabilities(network, batch.column("x").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    scores = pooled_docs.mapInArrow(run, "doc_id long, score double")
    return scores.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are predicted to be good, with all their columns.

    Trained as ``scored`` is; then every row is judged where it stands, so texts are not shuffled and repeated or missing
    ids do not matter.
    """
    plain = _plain(docs, id_col, text_col)
    vectors = word_vectors(plain)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)
    network = train(features(plain, vectors), labels)  # features are joined with the labels, not texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for _, texts in text_runs([batch.select([id_col, text_col])]):
                found, at = tokens(texts)
                good.append(_probabilities(network, [pooled(found[a:b], sent.value).tobytes() for a, b in zip(at, at[1:])]) >= THRESHOLD)
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, docs.schema)
