"""Table operators for molecular screening and simulation data on Spark DataFrames."""

from moltables.session import get_session

__all__ = ["get_session"]
