"""Noise on channels, and thinning of their samples. Each record's noise comes from numpy with
the record's seed, in the order of its channels, so that it does not depend on partitioning."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripchart.functions import arrays
from stripchart.operators.sampling import uniform
from stripchart.session import ship

SUFFIX = {"low": "_BF", "powerline": "_PL", "high": "_HF"}
RATES = (72, 100, 200)


# --- fixed values: ranges of the noise's size in millivolts, one of three levels each ----------
LEVELS = {
    "low": [(0.1, 0.25), (0.25, 0.5), (0.5, 0.75)],
    "powerline": [(0.01, 0.03), (0.03, 0.08), (0.08, 0.15)],
    "high": [(0.02, 0.05), (0.05, 0.1), (0.1, 0.15)],
}
# --- end of fixed values -----------------------------------------------------------------------


def _size(rng: np.random.RandomState, kind: str) -> float:
    least, most = LEVELS[kind][rng.randint(3)]
    return rng.uniform(least, most)


def _wave(frequency: float, t: np.ndarray, phase: float = 0.0) -> np.ndarray:
    return np.sin(2 * np.pi * frequency * t + phase)


def low(rng: np.random.RandomState, n: int, rate: float) -> np.ndarray:
    """Baseline wander: a slow sine, and normal noise of a tenth of its size smoothed over 100
    samples (over as many as there are, where they are fewer)."""
    t, size = np.linspace(0, n / rate, n), _size(rng, "low")
    rough = np.convolve(rng.normal(0, 0.1 * size, n), np.full(100, 0.01), mode="full")[49 : 49 + n]
    return size * _wave(rng.uniform(0.05, 0.3), t) + rough


def powerline(rng: np.random.RandomState, n: int, rate: float) -> np.ndarray:
    """The mains' hum of 50 or 60 Hz with its second and, at times, third harmonic."""
    t, size, phase = np.linspace(0, n / rate, n), _size(rng, "powerline"), rng.uniform(0, 2 * np.pi)
    hum = rng.choice([50.0, 60.0]) + rng.normal(0, 0.5)
    shares = [1.0, 0.3, 0.1 if rng.uniform() < 0.3 else 0.0]
    return size * sum(share * _wave(k * hum, t, phase) for k, share in enumerate(shares, 1))


def high(rng: np.random.RandomState, n: int, rate: float) -> np.ndarray:
    """Muscle noise: 40 to 50 Hz swelling slowly between nothing and its size, and white noise of
    a fifth of it."""
    t, size = np.linspace(0, n / rate, n), _size(rng, "high")
    swell = 0.5 + 0.5 * _wave(rng.uniform(0.1, 2.0), t)
    return size * swell * _wave(rng.uniform(40, 50), t) + rng.normal(0, 0.2 * size, n)


KINDS = {"low": low, "powerline": powerline, "high": high}


def with_noise(channels: DataFrame, seed: int = 42, rate: float = 500.0) -> DataFrame:
    """channels (ecg_id, place, name, samples, noise) with the named noise added to the samples.
    A record's channels are few, so each record is one group."""
    ship(channels.sparkSession)

    def add(record: pd.DataFrame) -> pd.DataFrame:
        record = record.sort_values("place")
        rng = np.random.RandomState((seed * 1_000_003 + int(record["ecg_id"].iloc[0])) % (1 << 32))
        made = []
        for samples, kind in zip(record["samples"], record["noise"]):
            x = np.asarray(samples, float)
            made.append(x + KINDS[kind](rng, len(x), rate) if kind in KINDS and len(x) else x)
        return record.assign(samples=made)

    return channels.groupBy("ecg_id").applyInPandas(add, channels.schema)


def suffix(noise: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for p in SUFFIX.items() for x in p))[noise], F.lit(""))


def thinned(channels: DataFrame, seed: int = 42, rate: float = 500.0, share: float = 0.3) -> DataFrame:
    """In a share of the records all channels are brought to 72, 100 or 200 Hz by interpolation;
    channels of fewer than ten samples, or that would not get shorter, stay."""
    key = F.col("ecg_id")
    target = F.element_at(F.array(*map(F.lit, RATES)), (F.floor(uniform("thin-rate", key, seed=seed) * len(RATES)) + 1).cast("int"))
    n = F.rint(F.size("samples") * target / rate).cast("int")
    apply = (uniform("thin", key, seed=seed) < share) & (n < F.size("samples")) & (n >= 10)
    times = channels.withColumn("_n", n).withColumn("_t", F.expr("transform(samples, (x, i) -> cast(i as double))")).withColumn("_grid", arrays.even_grid("0D", "(size(samples) - 1D)", "_n"))
    return times.withColumn("samples", F.when(apply, arrays.interpolated("_t", "samples", "_grid")).otherwise(F.col("samples"))).drop("_n", "_t", "_grid")
