"""Training-data operators: ten stages that turn raw documents into sharded training text.

Nothing else in the library imports this subpackage.  Functions that run in
Python tasks are pickled by value, so executors do not need this package on
their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
