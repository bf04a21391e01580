"""Spark operators for page-image translation data: page manifests, text
blocks, model replies, pixel crops, cached artifacts and edit logs."""

import sys

from pyspark import cloudpickle

# Functions travel to the Python workers by value, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
