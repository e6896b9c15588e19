"""Readers and writers, and the views that put the driver tables in domain shape."""

from pyspark import cloudpickle

from headwater.sources import blobs, geojson

# What reads files in tasks goes to the executors by value.
cloudpickle.register_pickle_by_value(blobs)
cloudpickle.register_pickle_by_value(geojson)
