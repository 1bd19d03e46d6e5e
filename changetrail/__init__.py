"""Change-activity log on Spark: record, search, export and expire who changed what."""

from changetrail.settings import Settings
from changetrail.sources.log_table import LogTable

__all__ = ["LogTable", "Settings"]
