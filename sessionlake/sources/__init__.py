"""Reading the logical tables, and writing them laid out for the operators."""
