"""Change feeds and replay."""
