"""A catalogue engine on Spark for dated, checksummed files."""

from dayledger.session import session
from dayledger.sources.pointers import DataLoader, catalogue

__all__ = ["DataLoader", "catalogue", "session"]
