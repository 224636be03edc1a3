"""cuelake: timed-text analytics on Spark.

Captions, recognised speech, on-screen text and the media timelines they belong to, as composable
``DataFrame -> DataFrame`` operators.
"""

__version__ = "0.1.0"
