"""Two-state Gaussian hidden Markov regimes of many series at once.

With two states, what is known at a bar is one number: the probability of the
calm state. The filter turns a prior into a posterior by adding the log density
ratio to the prior's log odds; the smoother works backwards from posteriors and
next priors. Both step through the bars once for a whole batch of series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds at most, relative gain in log likelihood that ends them, least deviation and least occupancy of a state.
ROUNDS, TOLERANCE, LEAST_SIGMA, LEAST_SHARE = 200, 1e-8, 1e-3, 0.02
#: Series fitted in one task at a time.
BATCH = 64
_EDGE = 1e-12


class Regimes:
    """Models of a batch of series: per series (and state) mean, variance, probability to stay, and of state 0 at the first bar."""

    def __init__(self, mean: np.ndarray, var: np.ndarray, stay: np.ndarray, first: np.ndarray) -> None:
        self.mean, self.var, self.stay, self.first = mean, var, stay, first

    def densities(self, x: np.ndarray) -> np.ndarray:
        """(2, series, bars) log densities."""
        m, v = self.mean.T[:, :, None], self.var.T[:, :, None]
        return -0.5 * (np.log(2 * np.pi * v) + np.square(x - m) / v)

    def next_prior(self, p: np.ndarray) -> np.ndarray:
        return np.clip(p * self.stay[:, 0] + (1 - p) * (1 - self.stay[:, 1]), _EDGE, 1 - _EDGE)

    def filter(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Priors and posteriors of state 0 per series and bar, and each bar's log likelihood."""
        density = self.densities(x)
        ratio = density[0] - density[1]
        prior, post = np.empty_like(x), np.empty_like(x)
        p = np.clip(self.first, _EDGE, 1 - _EDGE)
        for t in range(x.shape[1]):
            p = prior[:, t] = self.next_prior(p) if t else p
            odds = np.log(p) - np.log1p(-p) + ratio[:, t]
            p = post[:, t] = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        return prior, post, np.logaddexp(np.log(prior) + density[0], np.log1p(-prior) + density[1])


def fit_two_states(x: np.ndarray, length: np.ndarray | None = None) -> tuple[Regimes, np.ndarray]:
    """Models of the series in the rows of ``x`` by expectation-maximisation, calm state first, and which of them are sound.

    ``length`` is the number of bars of each series; what follows is ignored. A
    fit starts from the series' own mean and from a third and twice its variance.
    It is unsound if the series has under 100 bars or doesn't vary, if a state
    holds under 2 % of the bars, or if its deviation falls to the floor, a
    thousandth of the series' own.
    """
    x = np.asarray(x, float)
    n = np.full(len(x), x.shape[1]) if length is None else np.asarray(length)
    bars = np.arange(x.shape[1])
    here, more = bars < n[:, None], bars < n[:, None] - 1
    x = np.where(here, x, 0.0)
    mean = x.sum(axis=1) / np.maximum(n, 1)
    spread = np.where(here, np.square(x - mean[:, None]), 0).sum(axis=1) / np.maximum(n, 1)
    sound = (n >= 100) & (spread > 0) & np.isfinite(spread)
    spread = np.where(sound, spread, 1.0)
    floor = spread * LEAST_SIGMA**2
    model = Regimes(np.stack((mean, mean), 1), np.stack((spread / 3, spread * 2), 1), np.full((len(x), 2), 0.9), np.full(len(x), 0.5))
    reached = np.full(len(x), -np.inf)
    share = np.zeros(len(x))
    for _ in range(ROUNDS):
        prior, post, gain = model.filter(x)
        total = np.where(here, gain, 0).sum(axis=1)
        calm = post.copy()
        for t in range(x.shape[1] - 2, -1, -1):
            back0 = model.stay[:, 0] * calm[:, t + 1] / prior[:, t + 1] + (1 - model.stay[:, 0]) * (1 - calm[:, t + 1]) / (1 - prior[:, t + 1])
            calm[:, t] = np.where(more[:, t], post[:, t] * back0, post[:, t])
        after, ahead = calm[:, 1:], prior[:, 1:]
        use = more[:, :-1]
        stays0 = np.where(use, post[:, :-1] * model.stay[:, :1] * after / ahead, 0).sum(axis=1)
        stays1 = np.where(use, (1 - post[:, :-1]) * model.stay[:, 1:] * (1 - after) / (1 - ahead), 0).sum(axis=1)
        weight = np.stack((np.where(here, calm, 0), np.where(here, 1 - calm, 0)))
        held = np.maximum(weight.sum(axis=2), 1e-9)
        left = np.maximum(np.where(more, weight, 0).sum(axis=2), 1e-9)
        centre = (weight * x).sum(axis=2) / held
        var = (weight * np.square(x - centre[:, :, None])).sum(axis=2) / held
        stay = np.clip(np.stack((stays0, stays1)) / left, 1e-6, 1 - 1e-6)
        share = held.min(axis=0) / np.maximum(n, 1)
        model = Regimes(centre.T, np.maximum(var, floor).T, stay.T, calm[:, 0])
        done = np.abs(total - reached) <= TOLERANCE * np.maximum(np.abs(total), 1)
        reached = total
        if (done | ~sound).all():
            break
    sound &= (share >= LEAST_SHARE) & (model.var.min(axis=1) > floor)
    order = np.argsort(model.var, axis=1)
    swap = order[:, 0] == 1
    pick = lambda a: np.take_along_axis(a, order, axis=1)
    return Regimes(pick(model.mean), pick(model.var), pick(model.stay), np.where(swap, 1 - model.first, model.first)), sound


def regime_probabilities(returns: DataFrame, refit: int, least: int) -> DataFrame:
    """(asset, dt, p_calm): each bar's filtered probability under a model fitted on earlier bars only.

    Models are fitted every ``refit`` bars from bar ``least`` on. Assets are
    dealt to groups of about ``BATCH``, whose models are fitted together; a series
    is one row of a batch: its length is the number of bars, not of rows of the
    panel. Bars before the first fit are left out; p_calm is null where the fit
    was refused as unsound.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        assets = [g.sort_values("dt") for _, g in pdf.groupby("asset", sort=True)]
        for first in range(0, len(assets), BATCH):
            part = assets[first : first + BATCH]
            series = [(k, stop) for k, g in enumerate(part) for stop in range(least, len(g), refit)]
            if not series:
                continue
            ends = [min(stop + refit, len(part[k])) for k, stop in series]
            x = np.zeros((len(series), max(ends)))
            for i, (k, _) in enumerate(series):
                x[i, : ends[i]] = part[k].ret.to_numpy(float)[: ends[i]]
            model, sound = fit_two_states(x, np.array([stop for _, stop in series]))
            post = np.where(sound[:, None], np.round(model.filter(x)[1], 6), np.nan)
            for i, (k, stop) in enumerate(series):
                g = part[k].iloc[stop : ends[i]]
                found.append(pd.DataFrame({"asset": g.asset, "dt": g.dt, "p_calm": post[i, stop : ends[i]]}))
        return pd.concat(found) if found else pd.DataFrame({"asset": [], "dt": [], "p_calm": []})

    groups = max(1, -(-returns.select("asset").distinct().count() // BATCH))
    out = returns.groupBy(F.pmod(F.xxhash64("asset"), F.lit(groups))).applyInPandas(run, "asset string, dt date, p_calm double")
    return out.withColumn("p_calm", F.nanvl("p_calm", F.lit(None).cast("double")))
