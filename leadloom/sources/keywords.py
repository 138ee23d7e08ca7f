"""Keyword groups: small YAML data, read on the driver, for the row filters of ``operators.labels``."""

from __future__ import annotations

from dataclasses import dataclass
from importlib import resources
from pathlib import Path


@dataclass(frozen=True)
class KeywordGroups:
    """Words by group, excluded words by purpose, and regexes by group."""

    words: dict[str, tuple[str, ...]]
    excludes: dict[str, tuple[str, ...]]
    regexes: dict[str, tuple[str, ...]]


def _group_words(languages: dict) -> tuple[str, ...]:
    return tuple(dict.fromkeys(str(w) for words in languages.values() for w in words))


def load_keyword_groups(path: str | Path | None = None) -> KeywordGroups:
    """Groups of a YAML file with ``groups``, ``excludes`` and ``regexes``, or the bundled ones."""
    import yaml

    if path is None:
        text = resources.files("leadloom.data").joinpath("keyword_groups.yml").read_text(encoding="utf-8")
    else:
        text = Path(path).read_text(encoding="utf-8")
    data = yaml.safe_load(text) or {}
    return KeywordGroups(
        {name: _group_words(languages) for name, languages in data.get("groups", {}).items()},
        {name: tuple(words) for name, words in data.get("excludes", {}).items()},
        {name: tuple(patterns) for name, patterns in data.get("regexes", {}).items()},
    )
