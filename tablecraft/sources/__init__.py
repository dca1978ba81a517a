from tablecraft.sources.readers import (
    load_dir,
    read_csv,
    read_parquet,
    stage_files,
    table_digest,
)
from tablecraft.sources.writers import (
    discard,
    extract,
    load_factors,
    load_model,
    model_path,
    save_factors,
    save_model,
    write_table,
)

__all__ = [
    "discard",
    "extract",
    "load_dir",
    "load_factors",
    "load_model",
    "model_path",
    "read_csv",
    "read_parquet",
    "save_factors",
    "save_model",
    "stage_files",
    "table_digest",
    "write_table",
]
