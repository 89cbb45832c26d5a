"""Training-data operators.

Nothing else in the library imports this subpackage; each operator module is
usable alone, and ``queries`` binds the operators to the driver's tables.
"""
