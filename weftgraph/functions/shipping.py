"""Python functions that travel to executors by value, so that the package need not be installed there."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def by_value(module: str) -> None:
    """Pickle the functions of ``module`` with their code (call it at the end of the module)."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
