"""Column functions (Column -> Column) and ordered-data helpers."""
