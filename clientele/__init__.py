"""clientele — retail customer analytics as Spark DataFrame operators.

Layout:
  sources/    readers, writers, schema conforming, the test-table views
  functions/  Column -> Column helpers (text keys, dates, rule scores)
  operators/  DataFrame -> DataFrame operators (RFM, tertiles, flows, cohorts, ...)
  plans/      multi-stage pipelines and the query catalogue used by the checks
  streaming/  the transaction-cleaning stage run as a Structured Streaming job
"""

import sys as _sys

from clientele.session import build_session, ensure_checkpoint_dir

# Functions this package runs inside tasks (mapInPandas, pandas_udf) are
# shipped by value, so Python workers need not import the package (no
# --py-files step on a cluster, no sys.path dependency on the driver's cwd).
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # older cloudpickle: ship the package instead
    pass

__all__ = ["build_session", "ensure_checkpoint_dir"]
