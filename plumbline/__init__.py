"""plumbline: checks whether a reported gain is in the model or in its input, as Spark queries."""

__version__ = "0.1.0"
