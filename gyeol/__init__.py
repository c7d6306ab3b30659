"""A PySpark engine for corpus statistics and Korean text analytics."""
