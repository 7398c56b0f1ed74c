"""Reading and writing of document collections."""
