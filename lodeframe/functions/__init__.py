"""Types and typed expressions."""
