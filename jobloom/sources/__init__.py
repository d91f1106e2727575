"""Tables, captured pages and documents as DataFrames."""
