"""What counts as a definition, per language, held as rows."""
