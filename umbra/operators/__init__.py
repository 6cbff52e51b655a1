"""DataFrame operators: every one takes frames and parameters and returns a frame."""
