"""Running stream transforms: append sinks, change logs, tables built from them."""
