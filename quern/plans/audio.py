"""Parameters of audio preprocessing."""

from __future__ import annotations

from dataclasses import dataclass

MEL_SCALES = ("htk", "kaldi", "slaney")
LOG_MODES = ("none", "ln", "log10", "db")


@dataclass(frozen=True)
class WaveformProcessor:
    sample_rate: int = 16000
    normalize: bool = True
    length: int | None = None
    padding_value: float = 0.0


@dataclass(frozen=True)
class MelSpectrogram:
    sample_rate: int = 16000
    n_fft: int = 400
    win_length: int = 400
    hop_length: int = 160
    n_mels: int = 80
    f_min: float = 0.0
    f_max: float = 8000.0
    scale: str = "slaney"
    slaney_norm: bool = True
    power: float = 2.0
    floor: float = 1e-10
    log: str = "log10"
    center: bool = True
    db_reference: float = 1.0
    db_min: float = 1e-10
    db_range: float | None = None

    @classmethod
    def whisper(cls, n_mels: int) -> "MelSpectrogram":
        return cls(n_mels=n_mels)


@dataclass(frozen=True)
class WhisperFeatures:
    n_mels: int = 80
    n_samples: int = 480_000
