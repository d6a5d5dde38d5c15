"""Where triples and files come from and go to."""
