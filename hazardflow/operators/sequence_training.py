"""Escalation probabilities from sensor sequences: mini-batch AdamW over rows dealt to tasks.

The model is a logistic unit for each horizon on the standardized, flattened sequence. Every task takes a mini-batch of its own
rows, the gradient sums of all tasks are added, and all tasks make the same step: decoupled weight decay, gradients
cut to a norm of one, a cosine schedule over the epochs, and the weights of the epoch with the least validation loss
are kept.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from hazardflow.operators import workers

# Training settings of the escalation model.
EPOCHS = 20
BATCH = 64
RATE = 1e-3
DECAY = 1e-4
MOST_NORM = 1.0
BETAS = (0.9, 0.999)
SMALLEST = 1e-8
SEED = 42
CLIP = 1e-7
# With several tasks, batches grow so that an epoch has no more steps than this: each one is an exchange of sums.
MOST_STEPS = 100


@dataclass
class SequenceModel:
    """Weights by horizon on standardized inputs, and the losses of the fit."""

    horizons: list[int]
    mean: list[float]
    scale: list[float]
    weights: list[list[float]] = field(default_factory=list)
    bias: list[float] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)  # on the validation rows, by epoch
    best_epoch: int = -1

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def read(text: str) -> SequenceModel:
        return SequenceModel(**json.loads(text))

    def shares(self, flat: np.ndarray) -> np.ndarray:
        """Probability by horizon of flattened sequences."""
        weights = np.array(self.weights) / np.array(self.scale)
        return _logistic(flat @ weights.T + (np.array(self.bias) - weights @ np.array(self.mean)))

    def probabilities(self, sequence: Column) -> Column:
        """Probability by horizon, of an ``array<array<double>>`` column; null where the shape is another one."""
        model, size, horizons = self, len(self.mean), len(self.horizons)

        @arrow_udf("array<double>")
        def score(vectors: pa.Array) -> pa.Array:
            flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), size)
            found = model.shares(flat)
            offsets = np.arange(0, found.size + 1, horizons, dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.reshape(-1)))

        flat = F.flatten(sequence)
        fits = F.coalesce((F.size(flat) == size) & ~F.exists(flat, lambda v: v.isNull()), F.lit(False))
        zeros = F.array_repeat(F.lit(0.0), size)
        return F.when(fits, score(F.when(fits, flat.cast("array<double>")).otherwise(zeros)))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, CLIP, 1 - CLIP)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def _matrix(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flattened sequences, labels and the marks of validation rows, in an order that the rows themselves give."""
    flat = table["x"].combine_chunks()
    flat = flat.flatten() if len(table) else pa.array([], pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, size)
    labels = [c for c in table.column_names if c not in {"x", "held", "id"}]
    y = np.stack([table[c].to_numpy().astype(float) for c in labels], axis=1) if len(table) else np.empty((0, len(labels)))
    order = np.argsort(table["id"].to_numpy(), kind="stable")
    return x[order], y[order], table["held"].to_numpy(zero_copy_only=False).astype(bool)[order]


def _train(table: pa.Table, exchange: workers.Exchange, horizons: list[int], size: int, epochs: int, n_workers: int, seed: int) -> str:
    x, y, held = _matrix(table, size)
    sums = exchange.sum(np.concatenate([x[~held].sum(axis=0), (x[~held] ** 2).sum(axis=0), [(~held).sum(), held.sum()]]))
    n, n_held = max(sums[-2], 1), max(sums[-1], 1)
    mean = sums[:size] / n
    scale = np.sqrt(np.maximum(sums[size : 2 * size] / n - mean**2, 0))
    scale[scale < 1e-12] = 1.0
    x = (x - mean) / scale
    train_x, train_y, held_x, held_y = x[~held], y[~held], x[held], y[held]
    # All tasks take the same number of steps, the longest share's.
    shares = exchange.sum(np.eye(n_workers)[exchange.number] * len(train_x))
    batch = max(BATCH, -(-int(shares.max()) // MOST_STEPS)) if n_workers > 1 else BATCH
    steps = -(-int(shares.max()) // batch)
    weights = np.zeros((len(horizons), size + 1))  # the last column is the bias
    first, second, count = np.zeros_like(weights), np.zeros_like(weights), 0
    model = SequenceModel(list(horizons), mean.tolist(), scale.tolist())
    best = np.inf
    rng = np.random.default_rng([seed, exchange.number])
    for epoch in range(epochs):
        rate = RATE * (1 + np.cos(np.pi * epoch / max(epochs, 1))) / 2
        order = rng.permutation(len(train_x))
        for step in range(steps):
            rows = order[step * batch : (step + 1) * batch]
            own = np.hstack([train_x[rows], np.ones((len(rows), 1))])
            wrong = _logistic(own @ weights.T) - train_y[rows]
            total = exchange.sum(np.append((wrong.T @ own).reshape(-1), len(rows)))
            slope = (total[:-1] / max(total[-1] * len(horizons), 1)).reshape(weights.shape)
            slope *= min(1.0, MOST_NORM / (np.sqrt((slope**2).sum()) + 1e-6))
            count += 1
            first = BETAS[0] * first + (1 - BETAS[0]) * slope
            second = BETAS[1] * second + (1 - BETAS[1]) * slope**2
            weights *= 1 - rate * DECAY
            weights -= rate * (first / (1 - BETAS[0] ** count)) / (np.sqrt(second / (1 - BETAS[1] ** count)) + SMALLEST)
        loss = exchange.sum(np.array([_loss(_logistic(held_x @ weights[:, :-1].T + weights[:, -1]), held_y)]))[0]
        loss /= n_held * len(horizons)
        model.losses.append(loss)
        if loss < best or epoch == 0:
            best, model.best_epoch = loss, epoch
            model.weights, model.bias = weights[:, :-1].tolist(), weights[:, -1].tolist()
    return model.dump()


def train(
    sequences: DataFrame, validation: DataFrame, horizons: tuple[int, ...], size: int, epochs: int = EPOCHS,
    seed: int = SEED, n_workers: int | None = None,
) -> SequenceModel:
    """Fit to ``sequence`` and ``y{h}h`` of the training rows; ``validation`` decides which epoch is kept.

    Sequences that do not have ``size`` values are left out. Without validation rows the first epoch's weights are kept.
    """
    labels = [F.col(f"y{h}h").cast("double").alias(f"y{h}h") for h in horizons]

    def chosen(rows: DataFrame, held: bool) -> DataFrame:
        flat = F.flatten("sequence").cast("array<double>")
        own = rows.select(flat.alias("x"), *labels, F.lit(held).alias("held"))
        return own.where((F.size("x") == size) & ~F.exists("x", lambda v: v.isNull()))

    both = chosen(sequences, False).unionByName(chosen(validation, True))
    both = both.withColumn("id", F.xxhash64("x", *[f"y{h}h" for h in horizons]))
    n = n_workers or workers.count(sequences.sparkSession, both.count())
    return SequenceModel.read(
        workers.fit(both, n, lambda table, exchange: _train(table, exchange, list(horizons), size, epochs, n, seed))
    )
