"""DataFrame operators, from image formation to depth profiles."""
