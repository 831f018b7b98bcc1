"""Training-data operators: ten self-contained operators on documents, pages and vectors.

Nothing else in the library imports this subpackage; its queries are listed in ``registry``.
"""
