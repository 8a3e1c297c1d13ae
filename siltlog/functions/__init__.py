"""Column expressions of the versioned key-value model."""

from .columns import OPERATION_OVERHEAD, crc32_of, file_number, key_valid, operation_bytes, overlaps, run_name, shared_prefix, status_text

__all__ = ["OPERATION_OVERHEAD", "crc32_of", "file_number", "key_valid", "operation_bytes", "overlaps", "run_name", "shared_prefix", "status_text"]
