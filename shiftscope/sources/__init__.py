"""Reading and writing tables, documents, messages and archived results."""
