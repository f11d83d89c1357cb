"""Scalar and array functions as native column expressions."""
