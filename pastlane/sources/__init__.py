"""Archive, link dimension and live readings as DataFrames."""
