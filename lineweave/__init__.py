"""Line-network analytics on PySpark: sparse pixel, point and prediction tables in, DataFrames out."""
