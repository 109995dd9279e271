"""loomdex: corpus compilation and batched retrieval as DataFrame-in, DataFrame-out operators."""
