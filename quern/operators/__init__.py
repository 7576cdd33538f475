"""DataFrame algorithms: joins, windows, aggregations, and Arrow kernels applied to columns."""
