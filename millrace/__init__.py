"""millrace: content-feed analytics as Spark jobs.

Every operator takes DataFrames and returns a DataFrame.  ``millrace.plans`` holds the jobs that
compose them, ``millrace.operators`` the operators, ``millrace.functions`` column expressions and
Arrow UDFs, ``millrace.sources`` readers and sinks, ``millrace.streaming`` the streaming forms.
"""

from millrace.config import EngineConfig

__all__ = ["EngineConfig"]
