"""Reading and writing: tag text, vocabularies, manifests, JSON records, tile tables and containers."""
