"""Analytics over structured JSON database logs, as lazy DataFrames.

``LogAnalysis`` reads log files and offers every analysis; the modules below it take and return DataFrames.
"""

from .api import LogAnalysis

__all__ = ["LogAnalysis"]
