"""Relational operators on (entity, date) panels."""
