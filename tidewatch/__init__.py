"""tidewatch: Spark-native network-intrusion analytics.

Operators take and return DataFrames. Sub-packages:

* ``sources``   - readers for flow CSVs, study files, packet streams and the
  domain views derived from the test tables; sinks.
* ``functions`` - column expressions (label maps, bands, p-value helpers).
* ``operators`` - batch operators: preparation, packet detectors, response
  decisions, feedback cycles, explanations, metrics, statistics, models.
* ``streaming`` - Structured Streaming twins of the stateful detectors.
* ``plans``     - the registered queries and their DuckDB oracle SQL.
"""

__version__ = "0.1.0"
