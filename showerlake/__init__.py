"""showerlake: particle-shower compression and analytics on Spark DataFrames."""
