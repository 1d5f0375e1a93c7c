"""Inkgate: a document-ingestion gate as Spark DataFrame and streaming jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few pandas UDFs travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
