"""threadloom: discussion-thread analytics as Spark DataFrame operators.

Every operator is a function from DataFrame to DataFrame and works on any
number of threads at once; ``thread_id`` is the leading key everywhere.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Python functions travel to the executors with their code, so the workers
# need no installed copy of this package.
register_pickle_by_value(sys.modules[__name__])
