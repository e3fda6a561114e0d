from .keys import BigInteger, Character, KeyCodec, Pair, Text, Uuid, WholeNumber
from .merge import MAX, MIN, OVERWRITE, SUM, Algebraic, Fold, Overwrite, PandasFold, fold

__all__ = ["MAX", "MIN", "OVERWRITE", "SUM", "Algebraic", "BigInteger", "Character", "Fold", "KeyCodec", "Overwrite", "Pair", "PandasFold", "Text", "Uuid", "WholeNumber", "fold"]
