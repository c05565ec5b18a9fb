"""Telemetry analytics on Spark: normalise logs, build security features, run rules, grade detectors."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
