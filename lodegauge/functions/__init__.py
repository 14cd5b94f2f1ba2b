"""Part of lodegauge."""
