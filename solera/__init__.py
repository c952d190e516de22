"""solera: the energy-trading lake and FX alert analytics, expressed as Spark DataFrame jobs.

Layout
------
- ``session``        SparkSession construction and the shared checkpoint folder.
- ``mapping``        canonical tables (energy star schema, FX tables) derived from the driver tables.
- ``sources``        snapshot / lake / catalogue / export sources and sinks.
- ``operators``      transforms, joins, aggregates, data-quality checks, window features, cost, governance.
- ``functions``      small column-expression helpers (no Python UDFs).
- ``plans``          the named queries (Q1-Q3 and the rest), the batch ETL run and their SQL twins.
- ``streaming``      Structured Streaming versions of the tick / notification work.
"""

__all__ = ["session", "mapping"]
