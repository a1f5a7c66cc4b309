"""Operators for training-data pipelines. Nothing else in driftlens imports this subpackage."""
