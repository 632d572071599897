"""PySpark-native analytics for evaluation records, diffs, contracts and run reports."""
