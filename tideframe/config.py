"""Knobs of the build."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

VIDEO_EXTENSIONS = ("mp4", "mov", "mkv", "avi", "webm", "m4v")
TRANSCRIPT_EXTENSIONS = ("txt", "md", "json", "vtt", "srt")


@dataclass(frozen=True)
class Config:
    sample_fps: float = 1.0
    embedder: str = "default"
    cut_distance: float = 0.18
    sustain_frames: int = 2  # kept in manifests; nothing reads it
    min_state_seconds: float = 1.5
    merge_distance: float = 0.14
    scroll_min_shift_px: float = 6.0
    scroll_max_horizontal_px: float = 4.0
    scroll_min_response: float = 0.5
    scroll_min_run: int = 2
    scroll_min_embedding_change: float = 0.05
    stitch_max_height_px: int = 20000

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, data: dict) -> Config:
        """Unknown keys are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in data.items() if k in known})

    def with_flags(self, **flags) -> Config:
        """This configuration with every flag that was given (is not None)."""
        return Config(**{**asdict(self), **{k: v for k, v in flags.items() if v is not None}})
