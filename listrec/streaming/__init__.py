"""The same event operators on streams."""
