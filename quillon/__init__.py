"""quillon: a PySpark-native engine for event-history analytics and recommendation.

Every operator takes DataFrames (plus small scalar parameters) and returns
DataFrames.  Work runs on executors; the driver only sees parameters and a
handful of scalar sizes used to pick block counts.
"""

__version__ = "0.1.0"
