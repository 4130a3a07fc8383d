"""Settings of a run: one frozen value passed to the plans, no globals."""

from __future__ import annotations

from dataclasses import dataclass, field

# Defaults and allowed ranges of the answering settings.
DEFAULT_CHUNKS = 10
DEFAULT_MESSAGES = 10
CHUNK_RANGE = (1, 20)
MESSAGE_RANGE = (1, 20)
BLOCKS_PER_PAGE = 50
DELETIONS_PER_PAGE = 100
LOG_TAIL_ROWS = 300


@dataclass(frozen=True)
class Settings:
    num_chunks: int = DEFAULT_CHUNKS
    num_messages: int = DEFAULT_MESSAGES
    use_history: bool = True
    provider: str = "offline"
    # provider -> models it offers; the first one is used unless `model` names another
    models: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"offline": ("extractive",), "openai": ("gpt-4.1",)}
    )
    model: str | None = None
    search_column: str = "chunk"
    url_column: str = "source_url"
    title_column: str = "document_title"
    has_user_credential: bool = True

    def __post_init__(self):
        for name, value, (low, high) in (
            ("num_chunks", self.num_chunks, CHUNK_RANGE),
            ("num_messages", self.num_messages, MESSAGE_RANGE),
        ):
            if not low <= value <= high:
                raise ValueError(f"{name} must be between {low} and {high}, got {value}")
        if self.provider not in self.models:
            raise ValueError(f"unknown completion provider {self.provider!r}")

    @property
    def model_name(self) -> str:
        return self.model or self.models[self.provider][0]
