"""Rule files: YAML text to rule rows. Small configuration, read on the driver."""

from __future__ import annotations

from importlib import resources
from pathlib import Path

from leadloom import vocab
from leadloom.operators.intents import IntentRule


def _words(item: dict, key: str) -> tuple[str, ...]:
    return tuple(str(w) for w in item.get(key) or [] if str(w).strip())


def rule_rows(document: object) -> tuple[IntentRule, ...]:
    """Rules of a parsed rule file, in file order.

    Sections that are no lists and entries that are no mappings are passed over; an
    unknown intent is an error. The section's name is the default language.
    """
    sections = (document or {}).get("languages", {}) if isinstance(document, dict) or not document else None
    if not isinstance(sections, dict):
        raise ValueError("a rule file needs a 'languages' mapping")
    entries = [
        (section, item)
        for section, items in sections.items()
        if isinstance(items, list)
        for item in items
        if isinstance(item, dict)
    ]
    unknown = {str(i.get("intent", "other")) for _, i in entries} - set(vocab.INTENTS)
    if unknown:
        raise ValueError(f"unknown intents in the rule file: {sorted(unknown)}")
    return tuple(
        IntentRule(
            intent=str(item.get("intent", "other")),
            language=str(item.get("language", section)),
            keywords=_words(item, "keywords"),
            weight=float(item.get("weight", 1.0)),
            require_phone=bool(item.get("require_phone", False)),
            exclude_keywords=_words(item, "exclude_keywords"),
        )
        for section, item in entries
    )


def load_rules(path: str | Path | None = None) -> tuple[IntentRule, ...]:
    """Rules of a YAML file, or the bundled ones."""
    import yaml

    if path is None:
        text = resources.files("leadloom.data").joinpath("intent_rules.yml").read_text(encoding="utf-8")
    else:
        text = Path(path).read_text(encoding="utf-8")
    return rule_rows(yaml.safe_load(text))
