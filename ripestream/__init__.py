"""ripestream — irregular multi-source sensor time series on PySpark.

Every operator is a plain ``DataFrame -> DataFrame`` function built on the
public DataFrame API so that Catalyst plans the work.  Sub-packages:

* ``sources``   — readers / writers for sensor, spectral and message feeds
* ``functions`` — Column-level scalar functions (physics, zones, scoring)
* ``operators`` — DataFrame operators (quality, labels, as-of, features, stats)
* ``plans``     — the registered queries over the driver tables
* ``streaming`` — Structured Streaming versions of the feed operators
"""

__version__ = "0.1.0"
