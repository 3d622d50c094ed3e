"""Short-sequence search and sequence-table operators as Spark DataFrame programs."""

__version__ = "0.1.0"
