"""Electricity-meter analytics on Spark: DataFrames in, DataFrames out.

Sub-packages
------------
``sources``    readers, layout detection, exports, model persistence
``functions``  column expressions (calendar, numeric, text)
``operators``  cleaning, roll-ups, windows, reports, metrics, question routing
``plans``      training, benchmarking and forecasting jobs built from operators
``streaming``  Structured Streaming forms of the roll-ups
"""

__version__ = "0.1.0"
