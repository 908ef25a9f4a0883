"""Loss terms and score corrections of long-tailed classification, as columns or over model-size tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def soft_target_loss(logits: Column, targets: Column, weights: Sequence[float] | None = None, gamma: float = 0.0, smoothing: float = 0.0) -> Column:
    """Cross entropy against a distribution over classes; with ``gamma`` focal in the expected probability, with ``weights`` scaled by the expected class weight.

    ``smoothing`` mixes the uniform distribution into the target of the cross entropy only. With a one-hot target this is the usual focal loss.
    """
    top = F.array_max(logits)
    log_sum = F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x))
    log_p = F.transform(logits, lambda x: x - top - log_sum)
    mixed = F.transform(targets, lambda t: t * (1.0 - smoothing) + F.lit(smoothing) / F.size(targets)) if smoothing else targets
    loss = -_dot(mixed, log_p)
    if gamma:
        loss = loss * F.pow(1.0 - _dot(targets, F.transform(log_p, F.exp)), F.lit(gamma))
    return loss * _dot(targets, F.array(*[F.lit(float(w)) for w in weights])) if weights is not None else loss


def norm_scaled(logits: Column, norms: Sequence[float], tau: float) -> Column:
    """Scores divided by the norm of their class's weights to the power ``tau``; 0 leaves them."""
    if tau <= 0:
        return logits
    return F.zip_with(logits, F.array(*[F.lit(max(float(n), 1e-12) ** tau) for n in norms]), lambda x, n: x / n)


def deferred_weights(weights: Mapping[str, float], epoch: int, epochs: int, start: float) -> dict[str, float] | None:
    """Class weights of an epoch (1 on): none before ``start`` (a share of ``epochs``) is over."""
    return dict(weights) if epoch >= max(1, int(epochs * start)) else None


def contrastive_loss(
    anchors: DataFrame, key: str, label: str, vector: str, prototypes: DataFrame, positives: DataFrame, temperature: float = 0.1, negatives: int = 16, seed: int = 0, most: int = 100_000
) -> DataFrame:
    """key, loss: how much nearer an anchor is to its label's prototypes than to pseudo-random others.

    loss = -log(sum exp(s+) / (sum exp(s+) + sum exp(s-))) with s the cosine over ``temperature``. ``prototypes``: name, vector - one per technique or
    class, counted to be at most ``most`` before they are sent to the workers; ``positives``: label, name. Up to ``negatives`` others are drawn by key, all of them if
    there are no more. Anchors without vector or positive have no row. Keys are integers.
    """
    if prototypes.count() > most:
        raise ValueError(f"more than {most} prototypes")
    table = prototypes.where("vector is not null").orderBy("name").toPandas()
    own = positives.where("name is not null").groupBy(label).agg(F.collect_set("name").alias("names")).toPandas()
    names = table["name"].tolist()
    place = {n: i for i, n in enumerate(names)}
    of_label = {r[label]: sorted(place[n] for n in r["names"] if n in place) for _, r in own.iterrows()}
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in table["vector"]]) if names else np.empty((0, 1))
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    shared = anchors.sparkSession.sparkContext.broadcast((matrix, {k: v for k, v in of_label.items() if v}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, of_label = shared.value
        for b in batches:
            b = b[b[label].isin(list(of_label))]
            if not len(b):
                continue
            x = np.stack([np.asarray(v, dtype=np.float64) for v in b[vector]])
            s = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)) @ matrix.T / temperature
            plus, minus = np.zeros(s.shape, dtype=bool), np.zeros(s.shape, dtype=bool)
            for i, (k, name) in enumerate(zip(b[key], b[label], strict=True)):
                plus[i, of_label[name]] = True
                others = np.flatnonzero(~plus[i])
                if len(others) > negatives:
                    others = np.random.default_rng([seed, abs(hash(int(k)))]).choice(others, negatives, replace=False)
                minus[i, others] = True
            top = s.max(axis=1, keepdims=True)
            e = np.exp(s - top)
            near, far = (e * plus).sum(axis=1), (e * minus).sum(axis=1)
            yield pd.DataFrame({key: b[key].to_numpy(), "loss": -np.log(near / (near + far))})

    rows = anchors.where(F.col(vector).isNotNull()).select(key, label, vector)
    return rows.mapInPandas(run, f"`{key}` {dict(anchors.dtypes)[key]}, loss double")
