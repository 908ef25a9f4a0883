"""plans of skeinflow."""
