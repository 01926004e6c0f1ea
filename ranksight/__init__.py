"""ranksight: hybrid retrieval and knowledge-base analytics on PySpark."""

__version__ = "0.1.0"
