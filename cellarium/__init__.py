"""cellarium: a PySpark-native engine for data cubes with many dimensions."""
