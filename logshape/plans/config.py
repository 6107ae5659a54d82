"""What an analysis is asked for, and what it gives."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Config:
    input_files: list[str] = field(default_factory=list)
    top_n: int = 20
    exclude: list[str] = field(default_factory=list)
    variables: bool = False
    by_first: bool = False
    analyze: bool = False
    quiet: bool = False
    groups: tuple[list[int], list[int]] | None = None
    min_freq: int = 1


@dataclass
class Result:
    """Tables of an analysis; nothing has been collected but the counts."""

    files: list[str]
    file_stats: DataFrame
    parsed: DataFrame
    templates: DataFrame  # (file_id, key, cnt, first_line) after merging
    values: DataFrame  # (file_id, value, cnt, first_line)
    unmerged: DataFrame
    mapping: DataFrame
    token_count: int
    template_count: int
    merged_count: int
    seconds: float = 0.0

    @property
    def n_files(self) -> int:
        return len(self.files)
