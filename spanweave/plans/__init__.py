"""Whole plans: from samples to clips."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import attribute, classify, report, segment
from ..operators.pieces import in_pieces
from ..params import RULES, Rules


def detect(samples: DataFrame, r: Rules = RULES, videos: DataFrame | None = None, piece: int | None = None, stage: str | None = None) -> dict[str, DataFrame]:
    """The single-program plan: result (all samples), blocks, clips, summary. Nothing runs before a table is asked for.

    piece: cuts a series longer than so many samples for the flags. stage: a new folder that driver and executors
    share; the flags are written there at once and all four tables read them instead of deriving them again.
    """
    flags = classify.classify(samples, r) if piece is None else in_pieces(samples, lambda df: classify.classify(df, r), classify.reach(r), piece)
    if stage is not None:
        flags.write.parquet(stage)
        flags = samples.sparkSession.read.schema(flags.schema).parquet(stage)
    blocks = segment.blocks(flags, r, videos=videos)
    clips = segment.clips(blocks)
    return {"result": attribute.roles(flags, clips, r), "blocks": blocks, "clips": report.offsets(report.clip_table(clips, r)), "summary": report.run_summary(flags, blocks, r)}


def stepwise(samples: DataFrame, r: Rules = RULES) -> dict[str, DataFrame]:
    """The stepwise plan: candidates, review, blocks of reviewed samples."""
    flags = classify.classify_stepwise(samples, r)
    candidates = segment.candidates(flags, r)
    masked = attribute.reviewed(flags, candidates.where("review = 'dance'"), r)
    return {"result": masked, "candidates": candidates, "segments": segment.merged_candidates(candidates, r), "blocks": segment.blocks(masked, r)}
