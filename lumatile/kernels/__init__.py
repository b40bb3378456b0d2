"""Image kernels in numpy, without Spark: each works on one plane or volume."""
