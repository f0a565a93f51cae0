"""Signals: band powers of sampled series and template matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import cosine

# Frequency bands in Hz.
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 100.0)}


def band_powers(series: DataFrame, rate: float, window: bool = True) -> DataFrame:
    """series (id, samples array) to (id, power of each band, mean, deviation); the spectrum is that of the whole series."""

    def run(batches):
        for pdf in batches:
            rows = []
            for key, x in zip(pdf["id"], pdf["samples"]):
                x = np.asarray(x, dtype=float)
                spectrum = np.abs(np.fft.rfft(x * np.hanning(len(x)) if window and len(x) > 1 else x)) ** 2 / max(1, len(x))
                freq = np.fft.rfftfreq(len(x), 1 / rate) if len(x) else np.empty(0)
                rows.append([key, *(float(spectrum[(freq >= lo) & (freq < hi)].sum()) if len(x) else 0.0 for lo, hi in BANDS.values()), float(x.mean()) if len(x) else 0.0, float(x.std()) if len(x) else 0.0])
            yield pd.DataFrame(rows, columns=["id", *BANDS, "mean", "deviation"])

    return series.select("id", "samples").mapInPandas(run, "id long, " + ", ".join(f"{b} double" for b in BANDS) + ", mean double, deviation double")


def gain(f: np.ndarray, low: float | None, high: float | None, notch: float | None, order: int, q: float) -> np.ndarray:
    """What a Butterworth high-pass at `low`, low-pass at `high` and notch, run forwards and backwards, leave of each frequency."""
    g = np.ones(len(f))
    if low is not None:
        with np.errstate(divide="ignore"):
            g /= 1 + (low / np.maximum(f, 1e-300)) ** (2 * order)
    if high is not None:
        g /= 1 + (f / high) ** (2 * order)
    if notch is not None:
        off = (f * f - notch * notch) ** 2
        g *= off / np.maximum(off + (notch * f / q) ** 2, 1e-300)
    return g


def filtered(series: DataFrame, rate: float, low: float | None = None, high: float | None = None, notch: float | None = None, order: int = 4, q: float = 30.0) -> DataFrame:
    """series (id, samples) through zero-phase Butterworth filters and a notch of quality q, applied to the spectrum."""

    def run(batches):
        for pdf in batches:
            out = []
            for x in pdf["samples"]:
                x = np.asarray(x, dtype=float)
                out.append(np.fft.irfft(np.fft.rfft(x) * gain(np.fft.rfftfreq(len(x), 1 / rate), low, high, notch, order, q), len(x)).tolist() if len(x) else [])
            yield pd.DataFrame({"id": pdf["id"], "samples": out})

    return series.select("id", "samples").mapInPandas(run, "id long, samples array<double>")


def enrol(features: DataFrame) -> DataFrame:
    """(user, template): the mean of a user's feature vectors (user, features), place by place."""
    each = features.select("user", F.posexplode("features").alias("at", "x")).groupBy("user", "at").agg(F.avg("x").alias("x"))
    return each.groupBy("user").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("template"))  # one row a feature


def authenticate(templates: DataFrame, probes: DataFrame, threshold: float = 0.85) -> DataFrame:
    """probes (user, features) against templates (user, template): similarity and whether it reaches the threshold."""
    met = probes.join(templates, "user")
    return met.withColumn("similarity", cosine(F.col("features"), F.col("template"))).withColumn("accepted", F.col("similarity") >= threshold)
