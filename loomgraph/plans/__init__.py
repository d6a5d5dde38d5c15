"""Named queries over a triple table."""
