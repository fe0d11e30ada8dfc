"""ledgerlint: data-quality audits of tables of any size, expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"
