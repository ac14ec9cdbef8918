"""Sensor time-series anomaly engine on PySpark.

Everything takes and returns DataFrames.  A *samples* frame has key columns
(which trace a row belongs to), ``i`` (0-based position inside the trace) and
``v`` (the value).  A *windows* frame has key columns, ``k`` (window number) and
``x`` (the values as an array).
"""
