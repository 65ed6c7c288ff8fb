"""cityweave: civic event correlation as Spark DataFrame operators."""
from .params import Params

__all__ = ["Params"]
