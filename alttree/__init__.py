"""Boosted alternating decision trees on Spark DataFrames.

Row-sized data (labels, weights, node membership, bins) stays in DataFrames; the
model and a short list of candidate splits are the only things the driver holds.
"""

import sys

from pyspark import cloudpickle

# The Arrow functions below travel by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
