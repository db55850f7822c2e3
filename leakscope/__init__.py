"""Sensitivity analytics for text exchanged with language-model services, on Spark."""

import sys

from pyspark import cloudpickle

# The small Python helpers travel with the job; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
