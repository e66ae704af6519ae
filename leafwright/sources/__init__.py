"""Where pages, lines and blocks come from."""
