"""Tensor operators: each extends a plan by a projection, join, aggregate or generate."""

from tensorframe.operators.conv import col2im, conv1, conv2, conv2_backward_input, conv2_backward_weight, im2col, max_pool1, max_pool2, max_pool2_backward, max_pool2_switches
from tensorframe.operators.elementwise import add_assign, assign, binary, cast, fill, one_hot, relu, relu_backward, scaled, scaled_add, scaled_cast
from tensorframe.operators.linalg import dot, row_product
from tensorframe.operators.reduce import sum_all, sum_axes, sum_axis
from tensorframe.operators.shape import broadcast, broadcast_backward, collapse_axis, flatten, index_axis, permute, reshape, reverse_axes, standard_layout, transpose

__all__ = [
    "add_assign", "assign", "binary", "broadcast", "broadcast_backward", "cast", "col2im", "collapse_axis", "conv1", "conv2", "conv2_backward_input",
    "conv2_backward_weight", "dot", "fill", "flatten", "im2col", "index_axis", "max_pool1", "max_pool2", "max_pool2_backward", "max_pool2_switches", "one_hot", "permute",
    "relu", "relu_backward", "reshape", "reverse_axes", "row_product", "scaled", "scaled_add", "scaled_cast", "standard_layout", "sum_all", "sum_axes", "sum_axis", "transpose",
]
