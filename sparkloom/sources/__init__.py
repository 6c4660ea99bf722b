"""Reading and writing pages and documents."""
