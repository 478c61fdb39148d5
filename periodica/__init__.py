"""PySpark-native analytics engine for period-based submission tracking."""
