"""Production parameters that queries and pipeline share."""

import public_tokenizers

#: The vocabulary file of the token ids.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: Shares of all tokens that the mixture should have per domain; here a domain is a language.
TARGETS = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}

#: Similarity of word shingles, in percent, from which the pipeline takes documents as near-duplicates. ``op3`` has its own, 85.
NEAR_PERCENT = 80
