"""kittiwake: schema-declared, multi-index record tables as Spark plans."""

__version__ = "0.1.0"
