"""Field-service analytics on PySpark: reports, checks, ingest and a payment stream."""

from crewledger.schemas import FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS
from crewledger.session import build_session, prepare, shared_folder
from crewledger.sources.tables import Tables, load_tables

__all__ = [
    "FOREIGN_KEYS", "PRIMARY_KEYS", "SCHEMAS", "Tables", "build_session", "load_tables", "prepare",
    "shared_folder",
]
