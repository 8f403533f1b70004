"""siftmill: Spark-native mining and data-processing operators on DataFrames."""
