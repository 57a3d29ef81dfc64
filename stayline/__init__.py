"""stayline: intensive-care event tables to analysis-ready panels, on Spark DataFrames."""
