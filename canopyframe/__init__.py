"""Spark-native image-trait and sensor analytics.

Rasters, sensor logs and frame sequences are DataFrames; traits are Column
expressions, masked aggregates and window functions; numpy kernels run under
Arrow only where a pixel neighbourhood is needed.
"""
