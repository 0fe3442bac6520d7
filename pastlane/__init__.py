"""Live readings against the archive of the same sensors, on Spark.

The package is a set of functions from DataFrame to DataFrame:

``sources``    archive, link dimension and live readings as DataFrames
``functions``  Column expressions: slots, time of day, polygons, numerics
``operators``  filters, joins, averages, data windows and metrics
``streaming``  the same work on ``readStream`` frames
``plans``      whole queries put together from the above
"""
