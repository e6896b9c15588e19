"""Analytical operators: each takes DataFrames and returns a lazy DataFrame."""

from pyspark import cloudpickle

from headwater.operators import containment, simplify

# Their Arrow functions go to the executors by value.
cloudpickle.register_pickle_by_value(containment)
cloudpickle.register_pickle_by_value(simplify)
