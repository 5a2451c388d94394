"""Per-image kernels: small numpy functions applied by Spark, one image per row, never shuffled as pixels."""
