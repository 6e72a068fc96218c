"""Column functions: translated expressions and cleansing."""
