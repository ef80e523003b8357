from .ingest import ingest, read_stream  # noqa: F401
