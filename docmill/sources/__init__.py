"""Reading collections and writing results."""
