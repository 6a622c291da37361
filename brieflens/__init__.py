"""brieflens: retrieval and review analytics over document collections, on Spark.

The package is a set of DataFrame-in, DataFrame-out operators.  Nothing here
schedules, plans or stores anything itself: Catalyst picks the physical plan.

* ``functions``  column expressions (text, markdown, html, scoring rules)
* ``operators``  multi-row operators (ranking, expansion, audits, checks ...)
* ``sources``    readers and writers for files and chunk tables
* ``plans``      the registered queries, each with its SQL oracle
* ``streaming``  Structured Streaming jobs
"""

__version__ = "0.1.0"
