"""Jobs over tables."""
