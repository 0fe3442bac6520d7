"""The operators on streaming frames."""
