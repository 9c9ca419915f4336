"""Operators for large text corpora: filtering, near-duplicates, archives, formatting, scoring, mixing.

Functions of this package travel to executors by value, so a cluster needs no
copy of it beside the job.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
