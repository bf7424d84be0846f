"""Operators of a training-data pipeline. ``queries()`` and ``oracle_sql()`` give their registered queries."""
