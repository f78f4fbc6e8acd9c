"""Profiling, readiness, leakage, drift, interactions, transforms, training."""
