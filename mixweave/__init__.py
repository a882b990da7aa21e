"""mixweave: Gaussian mixtures and corpus preparation as Spark jobs."""
