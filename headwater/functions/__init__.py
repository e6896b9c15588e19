"""Column functions. Everything here is a native expression unless its docstring says Arrow.

The few Arrow functions are sent to the executors by value, so a cluster needs no copy of
this package on its workers.
"""

from pyspark import cloudpickle

from headwater.functions import canonical, geometry, outlines

cloudpickle.register_pickle_by_value(canonical)
cloudpickle.register_pickle_by_value(geometry)
cloudpickle.register_pickle_by_value(outlines)
