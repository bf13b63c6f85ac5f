"""DataFrame-to-DataFrame operators; the same code runs on batch and streaming frames."""
