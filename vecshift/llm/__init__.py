"""Training-data operators: extraction, filtering, de-duplication, privacy and mixing."""
