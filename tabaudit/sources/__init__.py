"""Reading and writing tables, archives, artifacts and the run index."""
