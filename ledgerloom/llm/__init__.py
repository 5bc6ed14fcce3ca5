"""Training-data operators: cleaning, scanning, de-duplication, scoring, packing."""
