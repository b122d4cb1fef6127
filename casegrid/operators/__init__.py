"""DataFrame -> DataFrame operators. Lazy and free of I/O unless the docstring says otherwise."""
