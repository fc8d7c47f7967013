"""A factorisation machine over sparse hashed features: training on the driver, scoring anywhere.

    raw(x) = bias + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

The bracket is the sum-of-squares identity: all pairwise interactions <v_i, v_j> x_i x_j in time linear in the number
of features.  Every feature that a text has counts with the value (n + soften) ** -power for n of them, so long texts do
not outweigh short ones, nor does one single feature decide.  Training is mini-batch AdaGrad on the logistic loss, on rows that fit in memory (the
callers state the bound), in a fixed order from a fixed seed, so that it gives the same model each time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class FMSettings:
    """dimensions: size of the hash space.  rank: length of v.  min_rows: a feature on fewer training rows is unused.

    keep, least_g: so many features that tell most about the label, by the G statistic on the training rows, enter the
    model, if the statistic is above least_g (a chance of about 1 in 2,000 for a feature that tells nothing).
    partners, keep_beside, least_g_beside: among the rows that have one of so many most telling features, so many others
    enter if the statistic over those rows alone is above the last (it is taken for many more pairs, so it is higher).
    positive_weight: weight of rows with label 1, as a power of (negatives / positives).
    """

    dimensions: int = 1 << 18
    rank: int = 4
    epochs: int = 6
    batch: int = 256
    rate: float = 0.1
    decay: float = 1e-4
    power: float = 0.5
    soften: float = 8.0
    min_rows: int = 5
    keep: int = 4096
    least_g: float = 12.0
    partners: int = 32
    keep_beside: int = 64
    least_g_beside: float = 30.0
    positive_weight: float = 0.5
    seed: int = 7


@dataclass
class FMModel:
    settings: FMSettings
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    used: np.ndarray
    notes: dict = field(default_factory=dict)

    def raw(self, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """index: all rows' feature numbers, one row after another; counts: how many each row has."""
        out = np.full(len(counts), self.bias)
        known = self.used[index]
        owner = np.repeat(np.arange(len(counts)), counts)[known]
        index, counts = index[known], np.bincount(owner, minlength=len(counts))
        full = counts > 0
        if not full.any():
            return out
        starts = (np.cumsum(counts) - counts)[full]
        scale = (counts[full] + self.settings.soften) ** -self.settings.power
        v = self.factors[index]
        s = np.add.reduceat(v, starts, axis=0, dtype=float) * scale[:, None]
        squares = np.add.reduceat((v * v).sum(axis=1), starts, dtype=float) * scale**2
        out[full] += np.add.reduceat(self.linear[index], starts, dtype=float) * scale + 0.5 * ((s * s).sum(axis=1) - squares)
        return out

    def score(self, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(index, counts), -30, 30)))


def _g(rows: list[np.ndarray], labels: np.ndarray, s: FMSettings, step: int = 1024) -> np.ndarray:
    """Each feature's G statistic against the label over some rows; 0 where too few rows have it."""
    n, positives = len(labels), labels.sum()
    if not 0 < positives < n:
        return np.zeros(s.dimensions)

    def rows_with(some: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(s.dimensions)
        for at in range(0, len(some), step):  # a stretch of rows at a time: the driver holds one copy of the features
            out += np.bincount(np.concatenate(some[at : at + step]), minlength=s.dimensions)
        return out

    hits = rows_with([r for r, y in zip(rows, labels) if y > 0])
    seen = hits + rows_with([r for r, y in zip(rows, labels) if y <= 0])

    def part(observed, expected):
        return np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    share = positives / n
    g = part(hits, seen * share) + part(seen - hits, seen * (1 - share))
    g += part(positives - hits, (n - seen) * share) + part(n - positives - (seen - hits), (n - seen) * (1 - share))
    g[seen < s.min_rows] = 0
    return 2 * g


def informative(rows: list[np.ndarray], labels: np.ndarray, s: FMSettings) -> np.ndarray:
    """True for the features that enter the model: those that tell by themselves, and those that tell beside one of the
    most telling ones, though they may say nothing alone."""
    g = _g(rows, labels, s)
    used = np.zeros(s.dimensions, bool)
    best = np.argsort(-g, kind="stable")[: s.keep]
    best = best[g[best] > s.least_g]
    used[best] = True
    beside = np.zeros(s.dimensions)
    for partner in best[: s.partners].tolist():
        some = [k for k, r in enumerate(rows) if (r == partner).any()]
        beside = np.maximum(beside, _g([rows[k] for k in some], labels[some], s))
    beside[used] = 0
    pairs = np.argsort(-beside, kind="stable")[: s.keep_beside]
    used[pairs[beside[pairs] > s.least_g_beside]] = True
    return used


def train(rows: list[np.ndarray], labels: np.ndarray, settings: FMSettings = FMSettings()) -> FMModel:
    """Fits rows (arrays of distinct feature numbers) to labels 0/1.

    Without rows of both labels the model scores every text with the share of label 1 (0.5 without any row).
    """
    labels = np.asarray(labels, float)
    s, n = settings, len(labels)
    positives = labels.sum()
    share = (positives + 1) / (n + 2)
    model = FMModel(
        s, float(np.log(share / (1 - share))), np.zeros(s.dimensions, np.float32), np.zeros((s.dimensions, s.rank), np.float32), np.zeros(s.dimensions, bool)
    )
    model.notes = {"rows": n, "positives": int(positives)}
    if not n or positives in (0, n):
        return model
    used = informative(rows, labels, s)
    known = [r[used[r]] for r in rows]
    sizes = np.array([len(r) for r in known])
    rng = np.random.default_rng(s.seed)
    w = np.zeros(s.dimensions, np.float32)
    v = np.where(used[:, None], rng.normal(0, 0.02, (s.dimensions, s.rank)), 0).astype(np.float32)
    gw, gv, bias, gb = np.full(s.dimensions, 1e-6, np.float32), np.full((s.dimensions, s.rank), 1e-6, np.float32), model.bias, 1e-6
    weight = np.where(labels > 0, ((n - positives) / positives) ** s.positive_weight, 1.0)
    for _ in range(s.epochs):
        order = rng.permutation(n)
        for at in range(0, n, s.batch):
            some = order[at : at + s.batch]
            counts = sizes[some]
            scale = ((counts + s.soften) ** -s.power).astype(np.float32)
            row = np.repeat(np.arange(len(some)), counts)
            index = np.concatenate([known[k] for k in some])
            distinct, place = np.unique(index, return_inverse=True)
            x = scale[row]
            wd, vd = w[distinct], v[distinct]
            vx = vd[place] * x[:, None]
            sums = np.zeros((len(some), s.rank), np.float32)
            lin = np.bincount(row, weights=wd[place] * x, minlength=len(some))
            for f in range(s.rank):
                sums[:, f] = np.bincount(row, weights=vx[:, f], minlength=len(some))
            inter = 0.5 * ((sums * sums).sum(axis=1) - np.bincount(row, weights=(vx * vx).sum(axis=1), minlength=len(some)))
            p = 1 / (1 + np.exp(-np.clip(bias + lin + inter, -30, 30)))
            err = ((p - labels[some]) * weight[some] / len(some)).astype(np.float32)
            ex = err[row] * x
            dw = np.bincount(place, weights=ex, minlength=len(distinct)).astype(np.float32) + s.decay * wd / s.batch
            dv = np.empty_like(vd)
            for f in range(s.rank):
                dv[:, f] = np.bincount(place, weights=ex * (sums[row, f] - vx[:, f]), minlength=len(distinct))
            dv += s.decay * vd / s.batch
            gw[distinct] += dw * dw
            gv[distinct] += dv * dv
            w[distinct] = wd - s.rate * dw / np.sqrt(gw[distinct])
            v[distinct] = vd - s.rate * dv / np.sqrt(gv[distinct])
            db = float(err.sum())
            gb += db * db
            bias -= s.rate * db / np.sqrt(gb)
    model.bias, model.linear, model.factors, model.used = bias, w, v, used
    return model
