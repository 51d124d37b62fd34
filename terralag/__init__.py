"""Geospatial feature tables and many-series forecasting as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
