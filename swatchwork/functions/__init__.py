"""Functions of the page and design analytics library."""
