"""Reading notes, schemas, templates, settings and tables, and writing results."""
