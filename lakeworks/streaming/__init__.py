"""Change data and generated streams."""
