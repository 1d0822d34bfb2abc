"""gridloom: least-cost routing over cost rasters, expressed as Spark plans."""

__version__ = "0.1.0"
