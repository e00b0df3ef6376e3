"""Operators for preparing training data at scale.

Nothing else in the library imports this subpackage.  Its functions are pickled
by value, so executors need none of this code installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
