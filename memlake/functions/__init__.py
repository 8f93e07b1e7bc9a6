"""Scalar functions: Column in, Column out, unless said otherwise."""
