"""Find where names are defined in a corpus of code and documents, as Spark jobs."""
