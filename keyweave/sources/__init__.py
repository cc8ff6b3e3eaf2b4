"""Reading and writing of record files, and versioned tables."""
