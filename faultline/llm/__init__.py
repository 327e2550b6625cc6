"""Training-data operators: one module each, their queries in ``queries``.

Nothing else in the library imports this package.
"""
