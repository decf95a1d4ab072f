"""Column -> Column functions; everything stays in JVM expressions unless noted."""
