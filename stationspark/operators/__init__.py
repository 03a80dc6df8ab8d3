"""Questions over observations; each operator takes and returns DataFrames, one row per device or device and period."""
