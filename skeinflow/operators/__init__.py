"""operators of skeinflow."""
