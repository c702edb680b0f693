"""Evaluation-evidence analytics as plain DataFrame-to-DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python helpers travel to the workers by value, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
