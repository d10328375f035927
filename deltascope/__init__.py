"""KPI-change analytics as Spark DataFrame operations."""
