"""skyfold: a PySpark-native engine that calibrates, scores, aligns and stacks image frames held in DataFrames."""
