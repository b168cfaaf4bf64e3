"""Thresholds and interval rules. Motion is compared in units of 1e-5, as integers, so rounding never decides a flag."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Rules:
    step: float = 3.0  # seconds between samples
    bridge_s: float = 27.0  # longest gap inside a block
    min_span_s: float = 24.0  # shortest span of a kept block
    shoulder_y: float = 0.44
    shoulder_width: float = 0.27
    knee: float = 0.35
    ankle: float = 0.20
    up: float = -0.40
    lateral: float = 0.45
    elbow: float = 115.0
    elbow_up: float = -0.55
    visible: float = 0.50
    loose_up: float = -0.58
    loose_lateral: float = 0.34
    loose_elbow: float = 132.0
    loose_elbow_up: float = -0.72
    loose_visible: float = 0.40
    wrist_move: float = 0.45
    motion_e5: int = 9000
    motion_anchor_e5: int = 13000
    motion_near_e5: int = 7500
    motion_leg_e5: int = 7000
    near: int = 2  # samples on each side of an anchor
    candidate_gap: int = 1
    candidate_least: int = 2
    candidate_pad_s: float = 1.5
    merge_gap_s: float = 15.0
    review_until_s: float = 5700.0

    def with_thresholds(self, keep: float | str | None = None, leg: float | str | None = None) -> Rules:
        """Overrides of the two relaxed motion limits; below 0 counts as 0, what is no number is ignored."""
        out = self
        for name, value in (("motion_near_e5", keep), ("motion_leg_e5", leg)):
            if value in (None, ""):
                continue
            try:
                out = replace(out, **{name: round(max(0.0, float(value)) * 100_000)})
            except (TypeError, ValueError):
                return out
        return out


RULES = Rules()

# Texts that the result tables carry.
BODY_STANDING, BODY_LEGS, BODY_OTHER = "站立", "露腿", "非站立"
HAND_POSE, HAND_LOOSE, HAND_MOVE, HAND_STILL = "舞蹈姿态", "放宽姿态", "手部运动", "静止"
RELAX_BOTH, RELAX_NEAR, RELAX_LEG, RELAX_NONE = "露腿+舞蹈邻域", "舞蹈邻域", "露腿", "无"
KEPT_YES, KEPT_NO = "是", "否"
REVIEW_DANCE, REVIEW_REJECTED, REVIEW_EXCLUDED = "dance", "rejected:seated", "excluded:seated"

# What a catalog takes as a series, and directories that hold results.
SUFFIXES = (".mp4", ".mkv", ".flv", ".mov", ".avi", ".ts", ".wmv", ".m4v", ".webm", ".mpg", ".mpeg", ".rmvb", ".3gp")
SKIPPED_DIRECTORIES = ("frames", "clips", "_internal", "logs", "__pycache__", ".build", "output")
