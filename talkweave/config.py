"""Parameters of the engine as frozen dataclasses, and their reading from environment-style maps.

Values that don't parse fall back silently to the default (operators P5, P16, C8-C10).
"""

from __future__ import annotations

import dataclasses
import math
import os
from collections.abc import Mapping

#: Words that switch a flag on, and modes of voice activity that ask for fusion.
TRUE_WORDS = frozenset(["1", "true", "yes", "on"])
FUSION_MODES = frozenset(["fused", "fusion", "hybrid"])


def env_float(env: Mapping[str, str], name: str, default: float, least: float | None = None, above: float | None = None) -> float:
    """A finite number from env, if it is at least `least` and greater than `above`; else the default."""
    try:
        value = float(env[name])
    except (KeyError, ValueError):
        return default
    ok = math.isfinite(value) and (least is None or value >= least) and (above is None or value > above)
    return value if ok else default


def env_int(env: Mapping[str, str], name: str, default: int | None) -> int | None:
    try:
        return int(env[name])
    except (KeyError, ValueError):
        return default


def env_flag(env: Mapping[str, str], name: str, default: bool) -> bool:
    return env[name].strip().lower() in TRUE_WORDS if env.get(name, "").strip() else default


def env_list(env: Mapping[str, str], name: str, default: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(x for x in (p.strip() for p in env[name].split(",")) if x) if name in env else default


def first_set(value: str | None, default: str) -> str:
    """The value unless it is null or empty."""
    return value or default


@dataclasses.dataclass(frozen=True)
class VadConfig:
    """Voice-activity detection."""

    frame_duration: float = 0.03
    hop_duration: float = 0.01
    fixed_threshold: float | None = None
    min_energy: float = 5e-4
    energy_ratio: float = 2.5
    noise_quantile: float = 0.2
    dynamic_share: float = 0.3
    peak_share: float = 0.95
    smoothing_frames: int = 5
    hysteresis_ratio: float = 0.7
    start_frames: int = 2
    end_frames: int = 3
    min_speech: float = 0.3
    min_silence: float = 0.2
    padding: float = 0.05
    fusion: bool = False
    model: str | None = None
    energy_weight: float = 0.4
    model_weight: float = 0.6
    fusion_on: float = 0.6
    fusion_off: float = 0.4
    fusion_gate: float = 0.15
    fusion_smoothing_frames: int | None = None

    @staticmethod
    def from_env(env: Mapping[str, str] = os.environ) -> VadConfig:
        """Fusion is on only if it is asked for, by its flag or a mode, and a model is named."""
        model = env.get("ASR_VAD_TRANSFORMER_MODEL", "").strip()
        wanted = env_flag(env, "ASR_VAD_FUSION", False) or env.get("ASR_VAD_MODE", "").strip().lower() in FUSION_MODES
        d = VadConfig()
        if not wanted or not model:
            return d
        number = lambda name, default: env_float(env, f"ASR_VAD_FUSION_{name}", default)
        smoothing = int(number("SMOOTHING_FRAMES", 0.0))
        return VadConfig(
            fusion=True,
            model=model,
            energy_weight=number("WEIGHT_ENERGY", d.energy_weight),
            model_weight=number("WEIGHT_TRANSFORMER", d.model_weight),
            fusion_on=number("ON", d.fusion_on),
            fusion_off=number("OFF", d.fusion_off),
            fusion_gate=number("GATE", d.fusion_gate),
            fusion_smoothing_frames=smoothing if smoothing > 0 else None,
        )


@dataclasses.dataclass(frozen=True)
class ChunkConfig:
    """Chunk planning and overlap merge."""

    sample_rate: int = 16_000
    chunk_seconds: float = 25.0
    overlap_seconds: float = 1.0
    margin_seconds: float | None = None
    contained_margin: float = 0.35
    boundary_margin: float = 0.35
    duplicate_gap: float = 0.5
    near_gap: float = 0.35
    clipped_gap: float = 0.2
    similarity: float = 0.72
    overlap_ratio: float = 0.8

    @property
    def overlap(self) -> float:
        """Clamped to half a chunk; none without chunks."""
        return max(0.0, min(self.overlap_seconds, self.chunk_seconds / 2)) if self.chunk_seconds > 0 else 0.0

    @property
    def margin(self) -> float:
        """Margin around speech: its own value, else the overlap (C4)."""
        return self.overlap if self.margin_seconds is None else self.margin_seconds

    @staticmethod
    def from_env(env: Mapping[str, str] = os.environ) -> ChunkConfig:
        d = ChunkConfig()
        margin = env_float(env, "ASR_VAD_BOUNDARY_MARGIN_SECONDS", -1.0, least=0.0)
        return ChunkConfig(
            chunk_seconds=env_float(env, "ASR_CHUNK_SECONDS", d.chunk_seconds),
            overlap_seconds=env_float(env, "ASR_OVERLAP_SECONDS", d.overlap_seconds),
            margin_seconds=margin if margin >= 0 else None,
            contained_margin=env_float(env, "ASR_CONTAINED_MATCH_EDGE_MARGIN_SECONDS", d.contained_margin, least=0.0),
        )


@dataclasses.dataclass(frozen=True)
class QualityConfig:
    """Silence, retry and diagnostics thresholds."""

    silence_threshold: float = 1e-3
    phrases: tuple[str, ...] = ("ご視聴ありがとうございました",)
    phrase_no_speech: float = 0.6
    phrase_compression: float = 2.4
    phrase_logprob: float = -1.0
    no_speech_max: float = 0.85
    no_speech_mean: float = 0.75
    silence_compression: float = 2.4
    silence_logprob: float = -1.0
    flag_logprob: float = -1.0
    flag_compression: float = 2.4
    flag_no_speech: float = 0.85
    min_run: int = 3
    many_segments: int = 6
    distinct_share: float = 0.5

    @staticmethod
    def from_env(env: Mapping[str, str] = os.environ) -> QualityConfig:
        d = QualityConfig()
        number = lambda name, default: env_float(env, f"ASR_{name}", default)
        return QualityConfig(
            silence_threshold=env_float(env, "ASR_SILENCE_THRESHOLD", d.silence_threshold, above=0.0),
            phrases=env_list(env, "ASR_HALLUCINATION_PHRASES", d.phrases),
            phrase_no_speech=number("HALLUCINATION_PHRASE_NO_SPEECH_MIN", d.phrase_no_speech),
            phrase_compression=number("HALLUCINATION_PHRASE_COMPRESSION_RATIO", d.phrase_compression),
            phrase_logprob=number("HALLUCINATION_PHRASE_AVG_LOGPROB", d.phrase_logprob),
            silence_compression=number("FORCE_SILENCE_COMPRESSION_RATIO", d.silence_compression),
            silence_logprob=number("FORCE_SILENCE_AVG_LOGPROB", d.silence_logprob),
            flag_logprob=number("FLAG_AVG_LOGPROB", d.flag_logprob),
            flag_compression=number("FLAG_COMPRESSION_RATIO", d.flag_compression),
            flag_no_speech=number("FLAG_NO_SPEECH_PROB", d.flag_no_speech),
        )


@dataclasses.dataclass(frozen=True)
class RequestConfig:
    """Inputs of a transcription request."""

    model: str = "whisper-large-v3"
    language: str = "ja"
    default_style: bool = True

    @staticmethod
    def from_env(env: Mapping[str, str] = os.environ) -> RequestConfig:
        """A setting that is there but blank switches the style off."""
        return RequestConfig(default_style=env.get("ASR_DEFAULT_STYLE_PROMPT", "1").strip().lower() in TRUE_WORDS)

    def resolved(self, model: str | None, language: str | None) -> tuple[str, str]:
        return first_set(model, self.model), first_set(language, self.language)


def filler_enabled(mode: str | None) -> bool:
    """Fillers are removed in final and clean transcripts."""
    return (mode or "").strip().lower() in ("final", "clean")
