"""Order-dependent kernels on one pair of trees or sequences."""
