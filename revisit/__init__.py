"""revisit: Spark-native analytics for watch and rewatch logs.

Operators are plain functions ``DataFrame -> DataFrame`` built from
``pyspark.sql.functions`` and windows. Sub-packages:

* ``sources``   scans, sinks, layout, and views over the test tables
* ``functions`` column helpers (null-safe division, time conversions, hashes)
* ``operators`` sequence, interval, count, report, quality and recommender ops
* ``plans``     end-to-end pipelines and the registered query catalog
"""

__version__ = "0.1.0"
