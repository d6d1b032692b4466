"""Session settings, materialisation and the query catalogue."""
