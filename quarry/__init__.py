"""A PySpark engine for curating, searching and selecting from a corpus of structured items."""
