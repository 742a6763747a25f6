"""Spark-native duplicate-media analytics: detection, clustering, ranking, change processing and serving queries."""

import sys

from pyspark import cloudpickle

# executors need not have the package installed: its functions travel whole with each job
cloudpickle.register_pickle_by_value(sys.modules[__name__])
