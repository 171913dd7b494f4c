"""cloudframe: point clouds, rasters, panoramas and curves as Spark DataFrames.

Points, neighbour pairs, covariance tensors, raster cells, polyline vertices and segment labels are tables.  Every
operator takes DataFrames and returns a DataFrame; nothing is evaluated until the caller runs an action, except for the
iterative operators, which say so in their docstrings.
"""

__version__ = "0.1.0"
