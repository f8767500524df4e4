"""folio: a document-corpus engine written as PySpark DataFrame jobs.

Every operator is a function from DataFrame(s) to a DataFrame. No operator
triggers an action; planning, code generation and shuffles are Catalyst's.
"""

__version__ = "0.1.0"
