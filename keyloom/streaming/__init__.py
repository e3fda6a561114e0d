from .upsert import upsert_stream

__all__ = ["upsert_stream"]
