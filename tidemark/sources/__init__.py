"""Reading, validating and writing panels."""
