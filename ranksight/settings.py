"""Fixed values of the engine, and the profiles in which its parts are combined."""

from __future__ import annotations

from dataclasses import dataclass

# Prefixes of texts that a harness writes in the user's name.
SYNTHETIC_PREFIXES = ("<system", "<skill-loaded", "<cron-fire")

# Folders and files that hold no knowledge.
SKIPPED_FOLDERS = (".git", ".venv", "__pycache__", "node_modules", ".pytest_cache", ".search", ".graph")
SKIPPED_IN_PROJECTS = (*SKIPPED_FOLDERS, "out", "bin", "build", "build_logs", ".index")

# Comment style by file ending.
COMMENT_STYLES = {
    "c": "c", "cc": "c", "cpp": "c", "cxx": "c", "h": "c", "hpp": "c", "py": "py", "sql": "sql", "yml": "yml", "yaml": "yml",
    "ini": "hash", "cfg": "hash", "cmake": "hash", "sh": "hash", "ps1": "ps1",
}

# Domains of enumerated fields.
SCOPES = ("personal", "work", "shared")
CATEGORIES = ("project", "infrastructure", "methodology", "entity", "tool", "reference")
STATUSES = ("active", "archived", "draft")
NOISE_ENTITIES = ("report", "python", "docker", "kubernetes", "k8s")
MODES = ("hybrid", "keyword", "semantic")
PLANES = ("knowledge", "skills", "streams", "tasks", "all")
KINDS = ("skill", "docs", "code")
AGENTS = ("kimi-code", "kimi-cli", "claude", "omp")

# Constants of ranking and abstention.
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K = 60
RERANK_POOL = 20
ABSENT_TOP_SCORE, ABSENT_MARGIN, ABSENT_SIMILARITY = 0.90, 0.0, 0.518
DEDUP_SIMILARITY, DEDUP_NEIGHBORS = 0.92, 3
CHUNK_SIZE, PREFIX_SIZE = 1_500, 200
EMBED_BATCH, EMBED_DIM, EMBED_CHARS = 32, 1_024, 10_000
ENTITY_SKILLS = 3
STALE_DAYS, STREAM_STALE_DAYS, LEAST_DESCRIPTION, MOST_LINES = 90, 30, 30, 1_000


@dataclass(frozen=True)
class SessionLimits:
    size: int = 1_500
    overlap: int = 200
    least: int = 30
    least_piece: int = 20


@dataclass(frozen=True)
class SearchProfile:
    """How one subsystem searches. ``pool`` and ``filtered_pool`` are candidates per branch for k results."""

    name: str
    analyzer: str = "words"
    pool_factor: int = 3
    filtered_factor: int = 3
    filtered_least: int = 0
    filter_first: bool = True
    inverse_score: bool = False
    rerank: bool = True
    abstain: bool = True
    hide_archived: str = "always"
    most_k: int = 50

    def pool(self, k: int, filtered: bool) -> int:
        return max(self.filtered_least, self.filtered_factor * k) if filtered else self.pool_factor * k


KB = SearchProfile("kb")
PROJECT = SearchProfile("project", analyzer="identifiers", hide_archived="filtered")
SESSIONS = SearchProfile("sessions", pool_factor=5, filtered_factor=50, filtered_least=500, rerank=False, abstain=False, hide_archived="never", most_k=30)
