"""Nothing here: the engine this one matches has no streams, so none are built."""
