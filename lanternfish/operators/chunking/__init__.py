"""Files to chunks: one row per piece of text worth retrieving.

A file is chunked alone, so tables are chunked without a shuffle; what cannot be
stated as expressions runs over Arrow batches.
"""

from .formats import CHUNK_SCHEMA, Chunk, chunk_file, chunk_table

__all__ = ["CHUNK_SCHEMA", "Chunk", "chunk_file", "chunk_table"]
