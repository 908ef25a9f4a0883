"""functions of skeinflow."""
