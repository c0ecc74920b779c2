"""Select statements as DataFrames."""
