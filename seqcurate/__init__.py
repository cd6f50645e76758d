"""Spark operators for curating, labelling, splitting and evaluating labelled sequence data."""

__version__ = "0.1.0"
