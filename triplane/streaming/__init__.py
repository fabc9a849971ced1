"""An extension beyond the batch engine: events and statements as streams."""
