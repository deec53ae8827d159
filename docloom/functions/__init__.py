"""Column functions: text in and text out, JSON replies of models, vectors."""
