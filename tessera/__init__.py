"""tessera: entity linking, text alignment and measurement over meeting and consultation records, written for Spark DataFrames."""
