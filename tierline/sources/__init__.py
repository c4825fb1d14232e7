from tierline.sources.files import (
    normalize_path, table_name_for, read_sources, path_sql,
    files_of, read_json_documents,
)
from tierline.sources.tables import load, TABLES
from tierline.sources.catalog import catalog_profile

__all__ = [
    "normalize_path", "table_name_for", "read_sources", "path_sql",
    "files_of", "read_json_documents", "load", "TABLES", "catalog_profile",
]
