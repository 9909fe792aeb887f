"""Training-data operators: near-dedup, quality, language, tokens, licences, chat, lines, packing, media."""
