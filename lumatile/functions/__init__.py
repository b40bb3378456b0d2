"""Named functions and array expressions."""
