"""Attack scenes, trajectories and player vectors from football tracking data, on Spark DataFrames."""
