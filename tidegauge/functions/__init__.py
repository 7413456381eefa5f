"""Column functions: filter language, GPS time, names, bits, derived quantities."""
