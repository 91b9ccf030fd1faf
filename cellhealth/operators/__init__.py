"""DataFrame-to-DataFrame operators; each one is lazy and runs wholly on the executors."""
