"""Sources, the movie catalog, fixtures from the given tables, and sinks."""
