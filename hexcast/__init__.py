"""hexcast: spatio-temporal risk analytics as Spark plans."""
