from .inspect import exchanges, operators, plan_text

__all__ = ["exchanges", "operators", "plan_text"]
