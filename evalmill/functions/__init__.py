"""Column functions: group keys, hashes, scores and array kernels."""
