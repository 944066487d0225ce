"""Settings, from arguments or environment variables of the same name in upper case."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

#: The suffixes that are scanned.
SUFFIXES = (".py", ".js", ".ts", ".java", ".cpp", ".c", ".go", ".rs", ".md", ".txt", ".json", ".yaml", ".yml", ".xml", ".html", ".css", ".sql", ".sh", ".rb", ".php", ".swift", ".kt", ".scala", ".dart", ".vue", ".jsx", ".tsx")
#: The directories that are not entered.
PRUNED = frozenset({".git", ".venv", "venv", "env", "__pycache__", "node_modules", ".idea", ".vscode", ".pytest_cache", ".mypy_cache", "build", "dist"})


@dataclass(frozen=True)
class Config:
    codebase_root: str = "."
    max_file_size: int = 10 * 1024 * 1024
    supported_suffixes: tuple[str, ...] = SUFFIXES
    pruned_directories: frozenset[str] = field(default=PRUNED)
    chunk_size: int = 1000
    chunk_overlap: int = 200
    #: How files without syntax chunks are cut: "text", "line" or "none".
    chunk_fallback: str = "text"
    collection_name: str = "code_chunks"
    store_buckets: int = 16
    embedding_provider: str = "hashing"
    embedding_dimension: int = 128
    embedding_model: str = ""
    embedding_host: str = ""
    embedding_api_key: str = ""
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    vector_weight: float = 0.6
    bm25_weight: float = 0.4
    top_k: int = 10
    rerank_threshold: float = 0.5
    ivf_lists: int = 0
    ivf_probes: int = 10
    graph_storage_path: str = "graph.json"
    log_level: str = "INFO"
    log_file: str = ""

    @classmethod
    def from_env(cls, **given) -> Config:
        """Arguments win over the environment, the environment over the defaults; 0 is a value like any other."""
        found = {}
        for f in fields(cls):
            raw = os.environ.get(f.name.upper())
            if f.name in given and given[f.name] is not None:
                found[f.name] = given[f.name]
            elif raw is not None and isinstance(f.default, (int, float, str)):
                found[f.name] = type(f.default)(raw)
        return cls(**found)
