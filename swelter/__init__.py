"""Heat-exposure analytics on Spark: gridded climatology, heat-wave detection, exposure features."""

__version__ = "0.1.0"
