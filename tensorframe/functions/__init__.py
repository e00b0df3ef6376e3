"""Losses, metrics and their gradients."""

from tensorframe.functions.criterion import accuracy, cross_entropy, cross_entropy_backward, cross_entropy_loss, cross_entropy_rows, epoch_stats, row_stats

__all__ = ["accuracy", "cross_entropy", "cross_entropy_backward", "cross_entropy_loss", "cross_entropy_rows", "epoch_stats", "row_stats"]
