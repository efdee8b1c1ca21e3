"""Surveillance-panel analytics as Spark DataFrame transforms.

Sub-packages:

* ``sources``   readers, sinks and named bundles of tables
* ``functions`` Column-level building blocks (cleaning, rates, small linear algebra)
* ``operators`` DataFrame transforms (reshape, join, roll-up, windows, statistics, series)
* ``plans``     whole analyses composed from the operators, and the query registry
"""

from panelspark.session import build_session

__all__ = ["build_session"]
