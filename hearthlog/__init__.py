"""hearthlog: personal-archive analytics as Spark DataFrame operators."""
import sys as _sys

from pyspark.cloudpickle import register_pickle_by_value as _register

# functions sent to Python workers carry their code with them, so executors
# need no copy of the package
_register(_sys.modules[__name__])
