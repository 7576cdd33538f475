"""NumPy kernels without Spark."""
