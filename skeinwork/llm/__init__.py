"""Training-data operators: similarity joins, archives, classifiers, packing, search."""
