"""Spark-native catalog engine for measurement files.

Every public operator takes DataFrames and returns DataFrames.  Modules:

* ``functions``  column expressions (ids, paths, filename features, gates, text)
* ``operators``  relational operators over catalog, inventory and batch tables
* ``sources``    listings, catalog versions, manifests, slide and image readers
* ``plans``      end-to-end flows and the registered queries
* ``streaming``  incremental discovery with Structured Streaming
"""

__version__ = "0.1.0"
