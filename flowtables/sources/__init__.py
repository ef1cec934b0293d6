"""Declared sources and sinks over folders and topics."""
