"""talweg: a PySpark-native analytics engine for regional indicators."""
