"""lateflow: fulfillment-defect analytics as Spark DataFrame jobs.

Subpackages: ``sources`` (schemas, CSV ingest, test-table mapping),
``functions`` (column expressions, exact rounding, chi-square tail),
``operators`` (facts, questions, Pareto, diagnostics, quality checks),
``plans`` (named jobs, SQL oracle, fact materialisation).
"""

import sys as _sys

__version__ = "0.1.0"

# Python functions that run inside tasks are shipped with the task by value, so
# executors need no installed copy of this package. Deployments
# that install it (or pass it with --py-files) lose nothing by this.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the hook
    pass
