"""Immutable, versioned, unique-key tables on Spark DataFrames."""

from .functions.merge import MAX, MIN, OVERWRITE, SUM, Fold, PandasFold, fold
from .operators import KeyedFrame, LayeredFrame, Reducer

__all__ = ["MAX", "MIN", "OVERWRITE", "SUM", "Fold", "KeyedFrame", "LayeredFrame", "PandasFold", "Reducer", "fold"]
