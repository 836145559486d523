"""tilewright: slide alignment, point warping and raster statistics as Spark DataFrames."""

__version__ = "0.1.0"
