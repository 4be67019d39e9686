"""Operators of a training-data pipeline. Nothing else in tidefold imports this subpackage."""
