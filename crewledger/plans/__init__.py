"""Named plans: the view catalogue and the queries over the driver tables."""
