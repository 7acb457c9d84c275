"""Healthcare claim and remittance analytics on Spark DataFrames."""
