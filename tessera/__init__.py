"""tessera: an analytics engine that compiles every front end to Spark plans."""

__version__ = "0.1.0"
