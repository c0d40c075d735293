"""marquetry: media-metadata resolution, fusion and corpus preparation on Spark.

Core operators live in ``operators``, scalar functions in ``functions``, inputs in ``sources``,
registered queries in ``plans`` and incremental jobs in ``streaming``. The subpackage ``llm`` is
optional: nothing outside it imports it.
"""

__version__ = "0.1.0"
