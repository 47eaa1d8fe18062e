"""DataFrame operators: rasters, sequences, time series, inference, and numpy kernels under Arrow."""
