"""Training-data operators. Nothing outside this package imports it; the registry adds its queries if it is there."""
