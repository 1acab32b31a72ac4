"""threadloom: analytics over conversation-export archives, expressed as Spark plans."""

__version__ = "0.1.0"
