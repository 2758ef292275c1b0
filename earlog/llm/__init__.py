"""Operators for training-data pipelines. Helpers travel with their tasks, so executors need no copy of the package."""
from earlog.functions.ship import by_value

by_value(__name__)
