"""Column functions: distances, grid cells and rectangle helpers."""
