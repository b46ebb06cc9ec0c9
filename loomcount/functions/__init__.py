"""functions of the engine; see README.md."""
