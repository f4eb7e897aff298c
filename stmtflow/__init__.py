"""SQL-traffic analytics as Spark jobs.

A captured statement log (batch or stream) is enriched with templates, N+1 and slow flags and
transaction labels, and then filtered, aggregated, listed, laid out on a timeline, exported or gated.
"""

from pyspark import cloudpickle

import stmtflow

# The few Arrow/pandas helpers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(stmtflow)
