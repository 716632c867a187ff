"""Find and explain unusual bank transactions and FX deals with Spark DataFrames."""
