"""Data sources and batching."""

from tensorframe.sources.batches import Permutation, batched, dense, sequential, shuffled
from tensorframe.sources.idx import digits, read_idx
from tensorframe.sources.idx_source import read_split, write_idx
from tensorframe.sources.iris import iris

__all__ = ["Permutation", "batched", "dense", "digits", "iris", "read_idx", "read_split", "sequential", "shuffled", "write_idx"]
