"""Column -> Column helpers.  No Python functions run per row anywhere here."""
