"""stripchart: biosignal documents and the tables around them, as Spark DataFrames."""
