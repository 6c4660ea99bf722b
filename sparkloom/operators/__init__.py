"""DataFrame operators over tables of page nodes."""
