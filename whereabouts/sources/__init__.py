"""Tables of files, and files derived from container files."""
