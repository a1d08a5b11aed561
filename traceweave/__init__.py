"""Trace analytics on Spark: packet traces to features, datasets and scores."""

import sys

from pyspark import cloudpickle

# The few Python helpers that run in tasks travel with the job, so executors
# need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
