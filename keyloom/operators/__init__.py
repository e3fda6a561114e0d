from .frame import KeyedFrame
from .layered import LayeredFrame, Reducer

__all__ = ["KeyedFrame", "LayeredFrame", "Reducer"]
