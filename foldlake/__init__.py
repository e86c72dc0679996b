"""foldlake: a PySpark engine for schemaless JSON documents kept as an ordered change log."""

__version__ = "0.1.0"
