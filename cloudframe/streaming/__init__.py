"""Scan folders as streams.

Per-row operators (coordinates, transforms, filters, colours, curvature measures) and per-cell aggregates take a streaming
DataFrame as they are; this package only adds the source.
"""
