"""Training-data operators: language marks, copies, look-alikes, mixing, packing, leaks, abuse scores."""
