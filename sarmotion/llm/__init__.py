"""Training-data operators over text documents."""
