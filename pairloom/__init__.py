"""Text-pair curation and analytics on Spark DataFrames."""
