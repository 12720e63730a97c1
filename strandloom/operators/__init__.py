"""DataFrame -> DataFrame operators over records."""
