"""Numerical kernels for work that SQL cannot express; plain numpy, batched over pairs where it counts."""
