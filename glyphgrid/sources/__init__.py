"""Image files: formats by their first bytes, readers and writers."""
