"""Readers and writers."""
from .readers import READERS, read  # noqa: F401
from .writers import manifest, shard_ids, write_shards  # noqa: F401
