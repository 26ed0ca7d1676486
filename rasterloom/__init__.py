"""Images as relations of pixels, and corpus preparation, as Spark DataFrame transformations."""
