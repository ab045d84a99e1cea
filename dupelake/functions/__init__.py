"""Column functions: paths, text formats, media metadata, vectors and hashes."""
