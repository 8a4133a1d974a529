"""Operators for large training-data pipelines over ``documents`` and ``pages``.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when the folder is present.
"""
