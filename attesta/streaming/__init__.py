"""Arriving records; an extension, as the batch operators have no streaming counterpart elsewhere."""
