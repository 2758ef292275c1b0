"""Ship helper functions with the task, so executors need no copy of this package."""
from __future__ import annotations

import sys

from pyspark import cloudpickle


def by_value(module_name: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
