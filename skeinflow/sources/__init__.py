"""sources of skeinflow."""
