"""Scalar functions built from Spark SQL expressions."""
