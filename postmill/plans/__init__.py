"""Bindings of the operators to the driver tables, with the matching SQL."""
