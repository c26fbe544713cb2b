"""tidemark: many-series forecasting analytics expressed as Spark DataFrame plans.

Series live in a long table ``series(series_id, t, ts, y)`` where ``t`` is the
contiguous 0-based row index of a series.  Every operator takes and returns
DataFrames; nothing is collected to the driver except small control values
(a maximum series length, a handful of candidate scores).
"""

from tidemark.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
