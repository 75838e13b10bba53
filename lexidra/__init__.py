"""Lexidra: retrieval analytics on Spark DataFrames.

Corpus, query and judgment tables go in; postings, centroids, ranked hits and
metric tables come out.  Every function maps DataFrames to DataFrames.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the task: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
