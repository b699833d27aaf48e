"""orrery: a PySpark-native engine for evidence extraction and inventory analytics."""
