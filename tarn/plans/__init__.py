"""Compilers from text to DataFrame plans: templates and note queries."""
