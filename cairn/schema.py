"""The tables of a store, and its limits."""

from __future__ import annotations

CHUNK_SIZE = 4 * 1024 * 1024
MOST_CHUNKS = 4096
LONGEST_NAME = 255
DEFAULT_PORT = 9000
LIST_CAP, WIRE_LIST_CAP = 1024, 128
PRODUCT, VERSION = "cairn", "0.1.0"

SOURCE_FILES = "name string, timestamp bigint, data binary"
MANIFESTS = "name string, version bigint, num_chunks bigint, file_size bigint, timestamp bigint, chunk_hashes array<string>"
MANIFEST_CHUNKS = "name string, version bigint, idx bigint, hash string"
CHUNKS = "hash string, size bigint, data binary, prefix string"
