"""casegraph: document-metadata and reconnaissance evidence analytics on Spark."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

# The few Python helpers travel with the job, so executors need no installed copy of the package.
register_pickle_by_value(sys.modules[__name__])
