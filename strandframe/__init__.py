"""Interval analytics on Spark DataFrames: datasets of samples with regions and metadata."""

from .dataset import Dataset

__all__ = ["Dataset"]
