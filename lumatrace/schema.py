"""Shapes of the tables and the constants that define results.

trace_points: dataset, trace_id, frame (from 1), time_ms, donor, acceptor [, acceptor2, acceptor_direct, factor, fret, ...]
idl_points: dataset, trace_id, frame, state (0: not assigned); dwells: dataset, trace_id, dwell_no, state, start_frame, n_frames
"""

from __future__ import annotations

from dataclasses import dataclass

KEYS = ["dataset", "trace_id"]


@dataclass(frozen=True)
class Constants:
    """Defaults of the trace analysis."""

    min_fret: float = 0.08
    fret_event: float = 0.14
    rle_min: int = 5
    background_frames: int = 100
    tau: int = 9
    n_std: float = 8.0
    overlap_std: float = 5.0
    blink_std: float = 4.0
    fret_low: float = -0.1
    fret_step: float = 0.03
    fret_bins: int = 44
    contour_length: int = 50


CONSTANTS = Constants()

# Default selection criteria.
CRITERIA = {"eq_overlap": 0, "min_corr": -1.1, "max_corr": 0.5, "min_snr": 8, "max_bg": 70, "max_ncross": 4, "min_acclife": 15}
