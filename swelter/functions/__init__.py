"""Column functions: no UDFs, everything stays inside generated code."""
