"""Fixtures, the query catalogue and its DuckDB counterparts."""

from pyspark import cloudpickle

import checks

cloudpickle.register_pickle_by_value(checks)
