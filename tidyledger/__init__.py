"""Numbers that can be trusted from messy records; see the README.

With this file the package is one folder: parts of another copy on the path (an optional
``llm`` that is not beside it) never count as its own.
"""
