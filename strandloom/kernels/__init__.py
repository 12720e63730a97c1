"""Numeric kernels without any Spark import."""
