"""Operators of a training-data pipeline, each a function from DataFrames to DataFrames.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Workers need no copy of the package on their path: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
