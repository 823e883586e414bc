"""Training-data operators: tokenising, scoring, decontamination, archives and near-duplicate removal."""
