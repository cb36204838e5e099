"""Default parameters of the operators."""

from __future__ import annotations

from dataclasses import dataclass

# Channel names of a motion signal, in channel order.
SIGNAL_CHANNELS = ("pan", "tilt", "zoom", "camera_magnitude")
VELOCITY_CHANNELS = ("pan", "tilt", "zoom")

# Ordered processing steps of a video.
PROCESSING_STEPS = ("downsampled", "optical_flow", "segmented", "described")

# Cost multiplier per quality rating (lower case).
QUALITY_MULTIPLIERS = {
    "excellent": 0.5,
    "good": 1.0,
    "medium": 2.0,
    "fair": 2.0,
    "bad": 5.0,
    "poor": 5.0,
}


@dataclass(frozen=True)
class SegmentationSettings:
    smoothing_window: int = 11
    smoothing_degree: int = 2
    scene_penalty: float = 3.0
    movement_penalty: float = 2.0
    min_size: int = 2
    jump: int = 5


@dataclass(frozen=True)
class EditorSettings:
    w1: float = 0.4
    w2: float = 0.3
    w3: float = 0.2
    w4: float = 0.1
    w5: float = 0.3
    alpha: float = 0.7
    candidates_per_scene: int = 15
    min_candidates: int = 3
    chains_per_scene: int = 5
    stitching_threshold: float = 0.6
    skip_stitching: bool = False


@dataclass(frozen=True)
class StoryboardSettings:
    max_revisions: int = 2
    review_threshold: float = 0.7
    context_threshold: float = 0.5


SEGMENTATION = SegmentationSettings()
EDITOR = EditorSettings()
STORYBOARD = StoryboardSettings()
