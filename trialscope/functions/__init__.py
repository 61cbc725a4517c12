"""Column functions: pure expressions over columns, no UDFs but where named so."""
