"""Named parameter sets for the cut-list jobs.

Fixed values: thresholds that decide results.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class CutParams:
    min_silence_ms: int = 100
    min_breath_ms: int = 60
    speech_pad_ms: int = 80
    min_keep_ms: int = 50
    mid_sentence_floor_ms: int = 3000
    sentence_pause_ms: int = 400
    min_word_confidence: float = 0.35
    low_confidence: float = 0.8
    low_confidence_min_gap_ms: int = 100
    preserve_start_ms: int = 300
    preserve_end_ms: int = 300
    # repeated takes
    min_retake_words: int = 3
    max_retake_gap_ms: int = 20_000
    min_match_ratio: float = 0.5
    bridge_ms: int = 1_000
    max_span_ms: int = 60_000
    take_boundary_ms: int = 2_000
    reword_overlap: float = 0.6
    reword_min_words: int = 3
    no_pause_gap_ms: int = 450
    no_pause_min_ratio: float = 0.75
    detect_aborted: bool = True


CODE_DEFAULTS = CutParams()
SHIPPED = replace(
    CODE_DEFAULTS,
    min_silence_ms=200,
    min_breath_ms=100,
    speech_pad_ms=150,
    min_keep_ms=200,
    mid_sentence_floor_ms=1000,
    sentence_pause_ms=600,
    max_retake_gap_ms=12_000,
)
