"""Training-data operators: licences, tokens, fingerprints, secrets, quality, joins, packing, chat."""
