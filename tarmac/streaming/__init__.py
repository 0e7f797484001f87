from tarmac.streaming.ingest import clean_rows, ingest_available, raw_stream, start_ingest

__all__ = ["clean_rows", "ingest_available", "raw_stream", "start_ingest"]
