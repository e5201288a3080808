"""excerpta: versioned, auditable document-evidence retrieval as Spark jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# The few Python functions that run in tasks travel with the task itself, so executors need no
# installed copy of this package.
register_pickle_by_value(sys.modules[__name__])
