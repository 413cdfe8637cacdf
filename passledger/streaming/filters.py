"""Sequential filters as keyed state: Doppler (three states) and offset (two).

Rows of one key are handled in time order, those of a stream once the watermark is past
them. A row that comes after later ones were handled changes nothing and comes out as
``late``, with nulls.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from passledger.streaming.runner import keyed


@dataclass(frozen=True)
class DopplerFilterConfig:
    initial_state: tuple[float, float, float] = (0.0, 0.0, 0.0)
    initial_variance: tuple[float, float, float] = (4.0, 2500.0, 100.0)
    process_rates: tuple[float, float, float] = (1e-6, 1e-4, 1e-4)
    centre_hz: float = 400e6
    gate: float | None = 6.63

    def __post_init__(self) -> None:
        if any(not math.isfinite(v) or v <= 0 for v in self.initial_variance):
            raise ValueError("initial variances must be finite and positive")
        if any(not math.isfinite(v) or v < 0 for v in self.process_rates):
            raise ValueError("process noise rates must be finite and nonnegative")
        if self.gate is not None and not (math.isfinite(self.gate) and self.gate > 0):
            raise ValueError("innovation gate must be finite and positive")


def along(nodes: list[float], divided: list[float], shift: float) -> tuple[float, float]:
    """Value and slope at ``shift`` of the polynomial with these nodes and divided differences."""
    value = slope = 0.0
    for node, term in zip(reversed(nodes), reversed(divided)):
        slope = value + (shift - node) * slope
        value = term + (shift - node) * value
    return value, slope


def doppler_step(
    x: np.ndarray, p: np.ndarray, dt: float, row: tuple, config: DopplerFilterConfig
) -> tuple[np.ndarray, np.ndarray, bool, float]:
    """Predict by dt, then take in one sample.

    ``row`` is (observed, variance, predicted at zero offset, its time slope); or, for a
    prediction that bends within an offset, (observed, variance, nodes, divided
    differences), which gives both at the offset of the state.
    Returns the state, covariance, whether it was accepted, and the NIS.
    """
    observed, variance, nominal, slope = row
    p = p + np.diag(config.process_rates) * dt
    ratio = (config.centre_hz + x[2]) / config.centre_hz
    if np.ndim(nominal):
        shifted, slope = along(nominal, slope, float(x[0]))
    else:
        shifted = nominal + slope * x[0]
    h = np.array([slope * ratio, 1.0, shifted / config.centre_hz])
    innovation = observed - (shifted * ratio + x[1])
    spread = float(h @ p @ h + variance)
    nis = innovation * innovation / spread
    if config.gate is not None and nis > config.gate:
        return x, p, False, nis
    gain = p @ h / spread
    keep = np.eye(3) - np.outer(gain, h)
    return x + gain * innovation, keep @ p @ keep.T + variance * np.outer(gain, gain), True, nis


DOPPLER_OUTPUT = (
    "contact_id string, t_us long, status string, nis double, time_offset_s double, "
    "bias_hz double, carrier_offset_hz double, offset_variance double"
)
_DOPPLER_STATE = "t_us long, x array<double>, p array<double>"


def doppler_filter(
    samples: DataFrame, config: DopplerFilterConfig = DopplerFilterConfig(), *, lateness: str = "1 minute", idle_s: float = 86_400.0
) -> DataFrame:
    """Filter every contact of a table or stream of enriched samples.

    ``samples`` holds contact_id, t_us, sequence (the order of equal times), observed_hz,
    variance_hz2 and the prediction: predicted_hz and slope_hz_s at zero offset, or
    node_s and node_hz, the nodes (seconds from the sample) and divided differences of
    its polynomial, taken anew at the offset of every step. A row with an unusable
    number is ``invalid`` and leaves the state alone; a gated row keeps only the prediction.
    """
    bent = "node_s" in samples.columns
    prediction = ["node_s", "node_hz"] if bent else ["predicted_hz", "slope_hz_s"]

    def usable(f, s) -> bool:
        if not bent:
            return math.isfinite(f) and math.isfinite(s)
        return f is not None and s is not None and 0 < len(f) == len(s) and bool(np.isfinite([*f, *s]).all())

    def late(key: tuple, rows: pd.DataFrame) -> list[tuple]:
        return [(key[0], int(t), "late", None, None, None, None, None) for t in rows["t_us"]]

    def advance(key: tuple, rows: pd.DataFrame, held: tuple | None) -> tuple[list[tuple], tuple | None]:
        if held is not None:
            last, x, p = held
            x, p = np.array(x), np.array(p).reshape(3, 3)
        else:
            last, x, p = None, np.array(config.initial_state), np.diag(config.initial_variance)
        out = []
        for t, z, r, f, s in zip(*(rows[c] for c in ["t_us", "observed_hz", "variance_hz2", *prediction])):
            t = int(t)
            nis = None
            if not (math.isfinite(z) and math.isfinite(r) and usable(f, s)) or r <= 0:
                status = "invalid"
            else:
                dt = 0.0 if last is None else (t - last) / 1e6
                x, p, accepted, nis = doppler_step(x, p, dt, (z, r, f, s), config)
                status, last = "accepted" if accepted else "gated", t
            out.append((key[0], t, status, nis, x[0], x[1], x[2], p[0, 0]))
        return out, None if last is None else (last, x.tolist(), p.ravel().tolist())

    kept = samples.select("contact_id", "t_us", "sequence", "observed_hz", "variance_hz2", *prediction)
    return keyed(kept, ["contact_id"], advance, late, DOPPLER_OUTPUT, _DOPPLER_STATE, lateness, idle_s)


@dataclass(frozen=True)
class OffsetFilterConfig:
    offset_rate: float = 0.001
    drift_rate: float = 0.0001
    maximum_gap_s: float = 20.0
    gate: float = 9.0
    initial_drift_variance: float = 0.02


OFFSET_OUTPUT = (
    "contact_id string, antenna_id string, ephemeris_id string, t_us long, status string, nis double, "
    "target_offset_s double, drift double, offset_variance double, accepted_samples long, window_start_us long"
)
_OFFSET_STATE = (
    "ephemeris_id string, t_us long, offset double, drift double, p00 double, p01 double, p11 double, "
    "accepted long, start_us long"
)


def offset_step(
    held: tuple | None, ephemeris: str, t: int, value: float, variance: float, config: OffsetFilterConfig
) -> tuple[tuple | None, str, float | None]:
    """One measurement of a pass: the new state, what happened, and the NIS.

    ``held`` follows the order of the stored state. A changed ephemeris or a gap
    beyond the limit starts over; an outlier keeps the prediction and the count.
    """
    if not (math.isfinite(value) and math.isfinite(variance)) or variance <= 0:
        return held, "invalid", None
    if held is not None and t < held[1]:
        return held, "late", None
    fresh = (ephemeris, t, value, 0.0, variance, 0.0, config.initial_drift_variance, 1, t)
    if held is None:
        return fresh, "started", None
    if held[0] != ephemeris or (t - held[1]) / 1e6 > config.maximum_gap_s:
        return fresh, "reset", None
    _, last, offset, drift, p00, p01, p11, accepted, start = held
    dt = (t - last) / 1e6
    offset += drift * dt
    p00 += dt * (2 * p01 + dt * p11) + config.offset_rate * dt
    p01 += dt * p11
    p11 += config.drift_rate * dt
    innovation = value - offset
    spread = p00 + variance
    nis = innovation * innovation / spread
    if nis > config.gate:
        return (ephemeris, t, offset, drift, p00, p01, p11, accepted, start), "gated", nis
    k0, k1 = p00 / spread, p01 / spread
    return (
        (
            ephemeris, t, offset + k0 * innovation, drift + k1 * innovation,
            (1 - k0) * p00, (1 - k0) * p01, p11 - k1 * p01, accepted + 1, start,
        ),
        "accepted",
        nis,
    )


def offset_filter(
    measurements: DataFrame, config: OffsetFilterConfig = OffsetFilterConfig(), *, lateness: str = "1 minute", idle_s: float = 86_400.0
) -> DataFrame:
    """Offset and drift of every pass from irregular measurements.

    ``sequence`` is the order of equal times.
    """

    def advance(key: tuple, rows: pd.DataFrame, held: tuple | None) -> tuple[list[tuple], tuple | None]:
        out = []
        for e, t, v, r in zip(rows["ephemeris_id"], rows["t_us"], rows["offset_s"], rows["variance"]):
            held, status, nis = offset_step(held, e, int(t), float(v), float(r), config)
            shown = held if held is not None else (None,) * 9
            out.append((*key, e, int(t), status, nis, shown[2], shown[3], shown[4], shown[7], shown[8]))
        return out, held

    def late(key: tuple, rows: pd.DataFrame) -> list[tuple]:
        return [(*key, e, int(t), "late", *(None,) * 6) for e, t in zip(rows["ephemeris_id"], rows["t_us"])]

    kept = measurements.select("contact_id", "antenna_id", "ephemeris_id", "t_us", "sequence", "offset_s", "variance")
    return keyed(kept, ["contact_id", "antenna_id"], advance, late, OFFSET_OUTPUT, _OFFSET_STATE, lateness, idle_s)
