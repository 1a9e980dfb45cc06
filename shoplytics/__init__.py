"""Click-shop analytics as PySpark DataFrame, SQL and Structured Streaming jobs.

Sub-packages:

* ``sources``    - table bindings, schemas, file/stream sources and sinks
* ``functions``  - column-expression helpers (URL, text, hashing, random draws)
* ``operators``  - batch jobs: event mapping, traffic, top pick, catalog, search,
                   basket and checkout
* ``streaming``  - the same jobs as Structured Streaming queries
* ``plans``      - the query registry used by ``__spark_entry__`` and ``bench.py``
"""

from shoplytics.session import get_spark, checkpoint_dir  # noqa: F401
