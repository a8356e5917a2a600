"""tidewatch: operating a data platform with Spark DataFrames.

Landing and registering datasets, metrics and alarms, reconciliation,
integrity rules and access analysis, all written as DataFrame plans.
"""

__version__ = "0.1.0"
