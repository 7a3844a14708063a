"""Training-data operators: archives, language, duplicates, quality, secrets, search, tokens, mixing.

Nothing outside this subpackage imports it.
"""
