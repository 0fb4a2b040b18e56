"""Sensor and water-chemistry analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Ship the package's small Python helpers with the tasks, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
