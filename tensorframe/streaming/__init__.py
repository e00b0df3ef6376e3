"""Streams of rows through a trained model."""

from tensorframe.streaming.scoring import score_stream

__all__ = ["score_stream"]
