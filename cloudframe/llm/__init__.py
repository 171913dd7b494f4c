"""Operators of a large training-data pipeline: deduplication, decontamination, mixing, labelling and formatting.

Nothing outside this package imports it; the queries are in ``queries.py``.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that these need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
