"""Operators for preparing training data at scale. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# executors need not have this package installed: its functions travel whole with each job
cloudpickle.register_pickle_by_value(sys.modules[__name__])
