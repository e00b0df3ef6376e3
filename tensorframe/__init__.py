"""A PySpark-native tensor and learning engine: tensors are DataFrames."""
