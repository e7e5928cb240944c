"""Quarrystone: a PySpark-native engine for confidence-scored dataset catalogs and run evaluation."""
