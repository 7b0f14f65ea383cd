"""Table, id-list, feature-set and model input and output."""
