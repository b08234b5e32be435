"""Panel time-series analytics expressed as Spark DataFrame, SQL and MLlib code."""

from panelloom.keys import KEYS, PanelKeys

__all__ = ["KEYS", "PanelKeys"]
