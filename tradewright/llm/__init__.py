"""Operators for preparing training data; nothing outside this package and corpus_pipeline.py imports it."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package with the tasks, so it needs no installation there. Broadcasts hold plain data.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
