"""Reading datasets and writing results."""
