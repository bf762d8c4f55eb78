"""Operations of a training-data pipeline over tables of texts, pages and vectors."""

import sys

from pyspark import cloudpickle

# executors need no copy of this package on their path: what a task uses travels with the task
cloudpickle.register_pickle_by_value(sys.modules[__name__])
