"""DataFrame -> DataFrame operators over bar series."""
