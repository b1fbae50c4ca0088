"""Operators of a training-data pipeline (see the README's section on them).

Nothing outside this subpackage imports it, except the guarded import in
``__spark_entry__.py``.
"""
