"""File formats: detection, structure summaries, and readers that give DataFrames."""
