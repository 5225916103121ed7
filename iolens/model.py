"""The contract of access logs and the settings of a simulated cache.

An *access* is one 4096-byte block read or written: ``seq`` (its place in the total order), ``vol``, ``blk``, ``is_read``, ``content`` (hash of the
block, null if unknown). ``ioblk`` is the block's physical number once volumes are applied.
"""

from __future__ import annotations

from dataclasses import dataclass

BLOCK_BYTES = 4096
BLOCKS_PER_MB = 256
MODES = ("plain", "fixed", "content", "chunk")

ACCESS_DDL = "seq bigint, vol int, blk bigint, is_read boolean, content string"


@dataclass(frozen=True)
class CacheConfig:
    """One simulated configuration.

    ``ram_blocks`` is the whole memory; in content mode ``content_blocks`` of it are a cache by content. ``write_updates`` re-maps a block's
    content when it is written; by default content mode does and the others do not (in plain mode there is nothing to map). ``reads`` and ``writes`` tell which accesses are replayed, ``iterations`` how
    often in a row the log is, with maps and cache kept. ``intra_only`` lets a block be led by blocks of its own volume only.
    """

    mode: str = "plain"
    ram_blocks: int = 1024 * BLOCKS_PER_MB
    content_blocks: int = 0
    write_updates: bool | None = None
    intra_only: bool = False
    reads: bool = True
    writes: bool = True
    iterations: int = 1

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if not (self.reads or self.writes):
            raise ValueError("enable reads, writes or both")
        if self.ram_blocks <= 0 or self.iterations <= 0:
            raise ValueError("memory and iterations must be positive")
        if self.mode == "content" and not 0 < self.content_blocks < self.ram_blocks:
            raise ValueError("the content cache must be larger than nothing and smaller than the memory")
        if self.mode != "content" and self.content_blocks:
            raise ValueError("only content mode has a content cache")
        if self.intra_only and self.mode != "fixed":
            raise ValueError("leaders within a volume are an option of fixed mode")

    @classmethod
    def of_mb(cls, mode: str, ram_mb: int = 1024, content_mb: int = 100, **kw) -> CacheConfig:
        return cls(mode, ram_mb * BLOCKS_PER_MB, content_mb * BLOCKS_PER_MB if mode == "content" else 0, **kw)

    @property
    def updates(self) -> bool:
        return self.mode == "content" if self.write_updates is None else self.write_updates and self.mode != "plain"

    @property
    def cache_blocks(self) -> int:
        return self.ram_blocks - self.content_blocks

    @property
    def name(self) -> str:
        """Different for configurations that differ in anything that matters: outcomes and counters go by it."""
        out = f"{self.mode}-{self.ram_blocks}" + (f"-{self.content_blocks}" if self.content_blocks else "")
        out += ("-w" if self.updates else "") + ("-intra" if self.intra_only else "")
        out += ("" if self.writes else "-reads") + ("" if self.reads else "-writes")
        return out + (f"-x{self.iterations}" if self.iterations > 1 else "")
