"""Part of the officium analytics engine."""
