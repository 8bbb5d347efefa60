"""Training-data operators: ten corpus operators and their queries.

Nothing else in the library imports this package. ``queries`` registers one
query per operator, the other modules hold the operators themselves.
"""
