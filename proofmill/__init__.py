"""proofmill: lint analytics over corpora of marked-up text, expressed as Spark plans.

A corpus is a table; rules, scopes, structure and reports are DataFrame transformations over it.
"""

__version__ = "0.1.0"
