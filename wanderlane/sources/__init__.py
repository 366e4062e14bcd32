"""Where graphs, query sets, indexes and ground truth come from and go to."""
