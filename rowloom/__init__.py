"""Table preparation, profiling, roll-ups and model training on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from rowloom.session import build_session, materialize, shared_dir

# Send the few Arrow functions to executors by value, so that a cluster does
# not need this package installed on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "materialize", "shared_dir"]
