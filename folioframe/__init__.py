"""folioframe: document structuring, conversion analytics and corpus preparation on Spark DataFrames."""
