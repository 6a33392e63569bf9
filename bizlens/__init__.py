"""bizlens: Spark-native analytics for business-licence registers.

Subpackages:
  sources    scans, sinks, schema enforcement, licence-shaped views
  functions  Column-level functions (name/address text rules, hashing, geo)
  operators  DataFrame operators (filters, joins, names, sampling, metrics ...)
  plans      registered queries and their DuckDB oracle SQL
  streaming  incremental address-feed ingest
"""

__version__ = "0.1.0"
