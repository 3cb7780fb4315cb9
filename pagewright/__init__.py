"""A Spark engine for scanned-document remediation: documents as ordered tables of pages."""

import sys

from pyspark import cloudpickle

# Workers need no copy of the package on their path: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
