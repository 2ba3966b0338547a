"""airmon: Spark operators for networks of hourly air-quality and wind monitors.

Every operator takes DataFrames (or Columns) and returns DataFrames (or Columns).  Nothing here
collects to the driver, keeps a global session or runs Python per row.
"""
