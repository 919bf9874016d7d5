"""Training-data operators: tokens, fingerprints, duplicates, quality, language, archives.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
``opN_<name>`` queries; every other module holds one operator with its own
general interface.
"""
