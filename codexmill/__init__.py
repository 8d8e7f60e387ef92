"""codexmill: a PySpark engine for multilingual text corpora.

Every operator takes DataFrames and returns a DataFrame; nothing collects an
unbounded result, and the batch form is the primary form.
"""

__version__ = "0.1.0"
