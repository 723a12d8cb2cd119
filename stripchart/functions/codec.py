"""Encodings of samples and coordinates, and of text in markup."""

from __future__ import annotations

import base64
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from stripchart.session import ship

#: Microvolts of a bit in waveform XML, and of a digit in annotated ECG XML.
UV_PER_BIT, UV_PER_DIGIT = 0.5, 5.0
#: Coordinate maps hold (coordinate + offset) * scale as unsigned 16-bit; version 1 scaled by 4.
MAP_OFFSET, MAP_SCALE, MAP_SCALE_V1 = 200.0, 16.0, 4.0


def adc_counts(samples: str, uv_per_bit: float = UV_PER_BIT) -> Column:
    """Millivolts to signed 16-bit counts: halves up, clamped; a missing sample is 0."""
    return F.expr(f"transform({samples}, x_ -> cast(least(32767, greatest(-32768, floor(coalesce(x_, 0D) * 1000 / {uv_per_bit}D + 0.5D))) as int))")


@F.pandas_udf(StringType())
def _packed(counts: pd.Series) -> pd.Series:
    return counts.map(lambda c: None if c is None else base64.b64encode(np.asarray(c).astype("<i2").tobytes()).decode())


@F.pandas_udf(ArrayType(DoubleType()))
def _unpacked(payloads: pd.Series, gains: pd.Series) -> pd.Series:
    def one(payload: str | None, gain: float):
        if payload is None or gain is None or np.isnan(gain):
            return None
        text = re.sub("[^A-Za-z0-9+/]", "", payload)
        text = text[: len(text) - (len(text) % 4 == 1)]
        raw = base64.b64decode(text + "=" * (-len(text) % 4))
        return np.frombuffer(raw[: len(raw) // 2 * 2], "<i2") * gain / 1000 if len(raw) > 1 else np.zeros(0)

    return pd.Series([one(*row) for row in zip(payloads, gains)], dtype=object)


def int16_base64(counts: str) -> Column:
    """Counts as little-endian signed 16-bit, in base64; a null array stays null."""
    ship(SparkSession.active())
    return _packed(F.expr(counts))


def int16_samples(payload: str, gain: str) -> Column:
    """Base64 of little-endian signed 16-bit counts to millivolts: count * gain / 1000. Other
    characters and a last odd byte are left out; null without payload or gain."""
    ship(SparkSession.active())
    return _unpacked(F.expr(payload), F.expr(f"cast({gain} as double)"))


def map_code(coordinate: Column) -> Column:
    scaled = F.rint((coordinate + F.lit(MAP_OFFSET)) * F.lit(MAP_SCALE))
    return F.least(F.greatest(scaled, F.lit(0.0)), F.lit(65535.0)).cast("int")


def map_coordinate(code: Column, version: int = 2) -> Column:
    return code / F.lit(MAP_SCALE if version > 1 else MAP_SCALE_V1) - F.lit(MAP_OFFSET if version > 1 else 0.0)


def xml_escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def hl7_digits(samples: str, length: str) -> Column:
    """Space-joined digits of 5 microvolts, padded with 0 to `length` samples."""
    return F.expr(f"array_join(transform(sequence(0, {length} - 1), i_ -> cast(floor(coalesce(get({samples}, i_), 0D) * 1000 / {UV_PER_DIGIT}D + 0.5D) as bigint)), ' ')")
