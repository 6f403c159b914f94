from sellerlens.sources.tables import SourceTables, load_tables
from sellerlens.sources import bindings, schemas

__all__ = ["SourceTables", "load_tables", "bindings", "schemas"]
