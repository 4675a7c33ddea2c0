"""Named queries of the point-cloud engine with their SQL, one module for each family of operators."""
