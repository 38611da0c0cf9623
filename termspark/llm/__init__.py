"""Training-data operators: de-duplication, search, language identification, archives, tokens and mixing.

Nothing outside this subpackage imports it.
"""
