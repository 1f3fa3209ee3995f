"""Part of facetspark."""
