"""cartwise: retail recommendation and analytics as Spark jobs.

Packages: ``sources`` (readers, writers, retail binding), ``operators``
(joins, filters, aggregates, windows, ranking), ``functions`` (column
expressions), ``ml`` (feature encoding and models on ``pyspark.ml``),
``plans`` (prepare / recommend / pipeline flows and the query registry),
``streaming`` (none needed).
"""
