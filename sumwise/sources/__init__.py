"""Reading tables and case files, registering datasets, writing results."""
