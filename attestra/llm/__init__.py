"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage. ``queries`` lists the
registered queries; each operator lives in a module of its own.
"""
