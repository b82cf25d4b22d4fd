"""cytoframe: DataFrame-native methylation analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so that a worker
# needs no copy of this package on its own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
