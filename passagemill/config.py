"""Settings, each a frozen record; the defaults are the engine's."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class ChunkConfig:
    size: int = 600
    overlap: int = 60
    technical_size: int = 1200
    technical_overlap: int = 120
    min_text_len: int = 20
    merge_short_tail: bool = False
    technical_types: tuple[str, ...] = ("technical", "schema", "erd")


@dataclass(frozen=True)
class RetrievalConfig:
    dense_k: int = 20
    sparse_k: int = 20
    return_k: int = 10
    rrf_k: int = 60
    interleave: bool = True
    prefilter_sparse: bool = False
    complete_interleave: bool = False
    resolve_role: bool = False


@dataclass(frozen=True)
class StoreConfig:
    path: str = "passage_store"
    alias: str = "corpus"
    dim: int = 384
    distance: str = "cosine"
    #: Parts are merged when there are more of them, or when the newer ones name more than this share of the base's rows.
    max_parts: int = 8
    merge_share: float = 0.5
    keep_versions: int = 2
    #: Columns that rows are laid out by, so that filters on them skip files and row groups, and columns with Bloom filters.
    sort_by: tuple[str, ...] = ()
    bloom: tuple[str, ...] = ()
    row_group_bytes: int = 128 << 20


@dataclass(frozen=True)
class SourceConfig:
    min_text_len: int = 20
    web_min_text_len: int = 100
    infer_type: bool = True
    join_tables: bool = True
    per_file_document: bool = True
    strip_tables: bool = False
    enable_ocr: bool = True
    ocr_dpi: int = 200
    parse_diagrams: bool = True
    max_crawl_pages: int = 30
    obey_robots: bool = True
    user_agent: str = "passagemill"
    timeout: float = 30.0
    sleep_seconds: float = 0.5


@dataclass(frozen=True)
class GeneratorConfig:
    model: str = "default"
    base_url: str = ""
    temperature: float = 0.2
    timeout: float = 60.0
    max_retries: int = 4
    backoff_base: float = 0.8
    backoff_factor: float = 1.8
    backoff_limited: float = 1.5
    backoff_cap: float = 10.0


@dataclass(frozen=True)
class EngineConfig:
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    store: StoreConfig = field(default_factory=StoreConfig)
    source: SourceConfig = field(default_factory=SourceConfig)
    generator: GeneratorConfig = field(default_factory=GeneratorConfig)

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> EngineConfig:
        """Store settings from QDRANT_PATH, COLLECTION_ALIAS, EMBEDDING_DIM, EMBEDDING_DISTANCE; the generator's from
        OPENROUTER_MODEL and OPENROUTER_BASE_URL."""
        e = os.environ if env is None else env
        d = StoreConfig()
        store = StoreConfig(e.get("QDRANT_PATH", d.path), e.get("COLLECTION_ALIAS", d.alias), int(e.get("EMBEDDING_DIM", d.dim)), e.get("EMBEDDING_DISTANCE", d.distance))
        g = GeneratorConfig()
        return cls(store=store, generator=GeneratorConfig(model=e.get("OPENROUTER_MODEL", g.model), base_url=e.get("OPENROUTER_BASE_URL", g.base_url)))


def api_key(env: dict[str, str] | None = None) -> str | None:
    """OPENROUTER_API_KEY, or else the text of the file that OPENROUTER_KEY_FILE names, or else None."""
    e = os.environ if env is None else env
    if key := e.get("OPENROUTER_API_KEY", "").strip():
        return key
    try:
        with open(e.get("OPENROUTER_KEY_FILE", "openrouter.key")) as f:
            return f.read().strip() or None
    except OSError:
        return None
