"""Fixed reference values: clinical tables, word lists and patterns the results depend on."""
