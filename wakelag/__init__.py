"""wakelag: lead-lag and quote-quality analytics for asynchronous quotes, as Spark plans."""

__version__ = "0.1.0"
