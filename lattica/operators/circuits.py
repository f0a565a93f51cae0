"""Quadratic binary problems on a simulated register: alternating and variational circuits, and evolution in a falling field.

A problem is rows (problem, i, j, q) over at most 14 variables; its 2^n amplitudes are one array in one task. Angles are
found by fixed rules and starts by a seed, so results repeat.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MOST = 14


def _energies(i, j, q, n: int) -> np.ndarray:
    """The energy of every state; bit k of a state is variable k."""
    bits = (np.arange(1 << n)[:, None] >> np.arange(n) & 1).astype(float)
    m = np.zeros((n, n))
    np.add.at(m, (i, j), q)
    return np.einsum("si,ij,sj->s", bits, m, bits)


def _turned(state: np.ndarray, gate: np.ndarray, k: int) -> np.ndarray:
    """A register after a 2 x 2 gate on variable k."""
    parts = state.reshape(-1, 2, 1 << k)
    return np.einsum("ab,xby->xay", gate, parts).reshape(-1)


def _mixed(state: np.ndarray, angle: float, n: int) -> np.ndarray:
    """Every variable turned about the flip axis."""
    gate = np.array([[np.cos(angle), -1j * np.sin(angle)], [-1j * np.sin(angle), np.cos(angle)]])
    for k in range(n):
        state = _turned(state, gate, k)
    return state


def _even(n: int) -> np.ndarray:
    return np.full(1 << n, 2.0 ** (-n / 2), dtype=complex)


def alternating(e: np.ndarray, n: int, layers: int = 4, rounds: int = 40, **_) -> np.ndarray:
    """Chances of the states after layers of phase and mixing; the angles start as a ramp and are moved while that lowers the mean."""
    scaled = e / max(1e-12, np.abs(e - e.mean()).max())

    def chances(angles: np.ndarray) -> np.ndarray:
        state = _even(n)
        for phase, mix in angles.reshape(layers, 2):
            state = _mixed(state * np.exp(-1j * phase * scaled), mix, n)
        return np.abs(state) ** 2

    ramp = (np.arange(layers) + 0.5) / layers
    angles = np.stack([2 * ramp, 0.8 * (1 - ramp)], axis=1).reshape(-1)
    least, step = chances(angles) @ e, 0.4
    for _round in range(rounds):
        moved = False
        for k in range(len(angles)):
            for way in (step, -step):
                tried = angles.copy()
                tried[k] += way
                if (mean := chances(tried) @ e) < least - 1e-12:
                    angles, least, moved = tried, mean, True
                    break
        if not moved:
            step /= 2
    return chances(angles)


def variational(e: np.ndarray, n: int, layers: int = 2, rounds: int = 12, starts: int = 4, seed: int = 1, **_) -> np.ndarray:
    """Chances after layers of turns and sign flips between neighbours; each angle in turn is set to its exact optimum."""
    both = np.arange(1 << n)
    signs = np.where(np.bitwise_count(both & both >> 1) % 2, -1.0, 1.0)

    def chances(angles: np.ndarray) -> np.ndarray:
        state = np.zeros(1 << n)
        state[0] = 1
        for row in angles:
            for k, a in enumerate(row):
                c, s = np.cos(a / 2), np.sin(a / 2)
                state = _turned(state, np.array([[c, -s], [s, c]]), k)
            state = state * signs
        return state**2

    best, r = None, np.random.default_rng(seed)
    for _start in range(starts):
        angles = r.uniform(0, np.pi, (layers, n))
        for _round in range(rounds):
            for at in np.ndindex(*angles.shape):
                held, means = angles[at], []
                for way in (0.0, np.pi / 2, -np.pi / 2):
                    angles[at] = held + way
                    means.append(chances(angles) @ e)
                # the mean is a sine in each angle
                angles[at] = held - np.pi / 2 - np.arctan2(2 * means[0] - means[1] - means[2], means[1] - means[2])
        found = chances(angles)
        if best is None or found @ e < best @ e:
            best = found
    return best


def evolved(e: np.ndarray, n: int, time: float = 40.0, steps: int = 400, field: float = 1.0, **_) -> np.ndarray:
    """Chances after a falling field gives way to the problem, in split steps of phase, mixing and phase."""
    scaled, dt = e / max(1e-12, np.abs(e - e.mean()).max()) * max(1, n) / 2, time / steps
    state = _even(n)
    for k in range(steps):
        share = (k + 0.5) / steps
        half = np.exp(-0.5j * dt * share * scaled)
        state = half * _mixed(half * state, -dt * (1 - share) * field, n)
    return np.abs(state) ** 2


METHODS = {"alternating": alternating, "variational": variational, "evolved": evolved}


def simulated(q: DataFrame, n: int, method: str, shots: int = 256, seed: int = 1, **options) -> DataFrame:
    """(problem, state, energy, mean) of each problem: the best state of `shots` measured ones, and the mean energy of the register."""
    if not 1 <= n <= MOST:
        raise ValueError(f"a simulated register has 1 to {MOST} variables")
    chances_of = METHODS[method]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        problem = int(rows["problem"].iloc[0])
        e = _energies(rows["i"].to_numpy(), rows["j"].to_numpy(), rows["q"].to_numpy(), n)
        p = chances_of(e, n, seed=seed, **options)
        seen = np.unique(np.random.default_rng([seed, problem]).choice(len(p), shots, p=p / p.sum()))
        best = seen[np.argmin(e[seen])]
        return pd.DataFrame({"problem": [problem], "state": [best], "energy": [e[best]], "mean": [p @ e]})

    return q.groupBy("problem").applyInPandas(run, "problem long, state long, energy double, mean double")
