"""Engine settings: one frozen object, always passed explicitly."""

from __future__ import annotations

import dataclasses
import json


@dataclasses.dataclass(frozen=True)
class EngineConfig:
    # Fixed default values of the data model.
    novel_threshold: float = 0.55
    known_threshold: float = 0.75
    chunk_size: int = 1000
    chunk_overlap: int = 150
    segment_target_chars: int = 1200
    segment_target_lines: int = 25
    atomic_line_limit: int = 40
    atomic_char_limit: int = 1800
    max_note_lines: int = 80
    max_notes_per_source: int = 1000
    draft_novel_first: bool = True
    append_margin: float = 0.05
    append_require_tag_overlap: bool = True
    tag_boost_enabled: bool = True
    tag_boost_per_tag: float = 0.06
    tag_boost_max: float = 0.15
    calibration_samples: int = 200
    sibling_links: int = 3
    context_top_k: int = 3
    context_chars: int = 400
    duplicate_threshold: float = 0.85
    transclude_depth: int = 0
    transclude_chars: int = 400
    rich_embeddings: bool = True
    auto_tag_top_k: int = 3
    auto_tag_max: int = 8
    default_tags: tuple[str, ...] = ("source-import",)
    filter_boilerplate: bool = True
    max_pages: int = 200
    max_source_chars: int = 2_000_000
    cue_window_seconds: float = 30.0
    debounce_seconds: float = 5.0
    related_links: int = 5
    media_per_note: int = 4
    media_table_rows: int = 12
    media_caption_chars: int = 200
    budget_calls: int = 50
    budget_chars: int = 400_000
    draft_batch: int = 5
    disable_after_failures: int = 2
    planning_max_segments: int = 400
    planning_segment_chars: int = 1600
    planning_total_chars: int = 120_000
    moc_min_notes: int = 2
    provider: str = "local"
    model: str = "all-MiniLM-L6-v2"
    output_folder: str = "sources"
    output_layout: str = "nested"
    frontmatter_type: str = "atomic"
    frontmatter_status: str = "draft"

    # Physical limits of this engine (not of the data model).
    broadcast_bytes: int = 64 * 1024 * 1024
    vectors_per_block: int = 2048

    def __post_init__(self) -> None:
        if not 0.0 <= self.novel_threshold < self.known_threshold <= 1.0:
            raise ValueError("need 0 <= novel_threshold < known_threshold <= 1")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be below chunk_size")

    def replace(self, **changes) -> EngineConfig:
        return dataclasses.replace(self, **changes)

    def space_id(self) -> str:
        """Identity of the embedding space an index belongs to."""
        import re

        return f"{self.provider}_{re.sub(r'[^a-zA-Z0-9_-]+', '_', self.model)}"

    def analysis_settings_json(self) -> str:
        """Settings that shape an analysis, as canonical JSON (sorted keys)."""
        shaping = {
            "segment_target_chars": self.segment_target_chars,
            "filter_boilerplate": self.filter_boilerplate,
            "novel_threshold": self.novel_threshold,
            "known_threshold": self.known_threshold,
            "embedding_provider": self.provider,
            "embedding_model": self.model,
            "tag_similarity_enabled": self.tag_boost_enabled,
            "tag_similarity_boost_per_tag": self.tag_boost_per_tag,
            "tag_similarity_max_boost": self.tag_boost_max,
            "max_notes_per_source": self.max_notes_per_source,
            "atomic_note_line_limit": self.atomic_line_limit,
            "atomic_note_char_limit": self.atomic_char_limit,
            "title_algorithm_version": "1",
        }
        return json.dumps(shaping, sort_keys=True, separators=(",", ":"))


DEFAULTS = EngineConfig()
