"""Plans above single operators: the tape, layers, optimizers, training."""

from tensorframe.plans.autograd import Checkpoints, Node, Parameter, Variable, gradient_table
from tensorframe.plans.layers import Conv1, Conv2, Dense, Flatten, Identity, Layer, MaxPool1, MaxPool2, OneOf, Optional, Relu, Sequential, lenet5
from tensorframe.plans.optim import SGD, Optimizer, load_model, save_model

__all__ = ["SGD", "Checkpoints", "Conv1", "Conv2", "Dense", "Flatten", "Identity", "Layer", "MaxPool1", "MaxPool2", "Node", "OneOf", "Optimizer", "Optional", "Parameter", "Relu", "Sequential", "Variable", "gradient_table", "lenet5", "load_model", "save_model"]
