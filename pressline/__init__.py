"""Press releases to a geo-referenced incident table, as Spark DataFrame operators.

Layers, each usable alone:

* ``functions``  column helpers (``Column`` in, ``Column`` out)
* ``sources``    landed pages, feeds and JSON payloads to rows; source profiles
* ``operators``  table in, table out
* ``plans``      the three composed jobs: ingestion, map query, tip triage
* ``streaming``  the ingestion operators under Structured Streaming
"""

__version__ = "0.1.0"
