"""Training-data operators: one module per operator, queries in ``queries.py``.

Nothing else in the library imports this package; ``__spark_entry__.py`` adds
its queries only when it can be imported.
"""
