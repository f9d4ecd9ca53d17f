"""Run options; they live on the driver and are handed to operators as values."""

from __future__ import annotations

from dataclasses import dataclass

# The limits and defaults users rely on.
SEARCH_MODES = ("naive", "local", "global", "hybrid", "mix")
DEFAULT_LIMIT = 10
CONTEXT_LIMIT = 5
MAX_TOKEN_SIZE = 8192
CHUNK_TOKENS = 8191
CODE_WINDOW_LINES = 800
NODE_BATCH = 500
EDGE_BATCH = 100
TRIPLE_LIMIT = 300


@dataclass(frozen=True)
class Options:
    sitemap_only: bool = False
    db_path: str = "data/default_db"
    output_dir: str = "output"
    max_token_size: int = MAX_TOKEN_SIZE
