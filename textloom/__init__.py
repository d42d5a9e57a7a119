"""Text-corpus preparation on Spark: scan, clean, chunk, tokenize, pack, mix."""

import sys

from pyspark import cloudpickle

# Functions sent to tasks carry their code along, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
