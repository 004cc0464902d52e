"""Operators of a training-data pipeline; nothing else in folia imports this subpackage."""
