"""Training-data operators: URL filters, deduplication, classifiers, sharding, search, tokenising and packing.

Functions that run on executors are pickled by value, so a cluster needs numpy
and pyarrow on its workers but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
