"""Descriptive profiles of PySpark DataFrames: kinds of variables, and the summaries that make sense for each."""

import sys

from pyspark import cloudpickle

from descry.config import Config
from descry.kinds import CardinalityRegime, VariableClass, VariableSubtype, VariableType
from descry.plans.describe import describe, describe_pair
from descry.profiles import ColumnProfile, DatasetProfile, VizSuggestion

__all__ = [
    "CardinalityRegime", "ColumnProfile", "Config", "DatasetProfile", "VariableClass", "VariableSubtype", "VariableType", "VizSuggestion", "describe",
    "describe_pair",
]

#: Functions of this package travel to the executors by value, so that these need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
