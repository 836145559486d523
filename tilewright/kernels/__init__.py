"""NumPy kernels over tiles and groups of points, for what SQL cannot express."""
