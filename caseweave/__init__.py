"""caseweave: evidence analytics over large document collections, on Spark."""
import sys

from pyspark import cloudpickle

# Python functions travel with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
