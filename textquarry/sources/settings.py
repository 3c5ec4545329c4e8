"""Settings that change how requests are read: misspellings, exclusions, presets of archive types.

Each has values of its own, and a file may override them: ``wrong=right`` lines, words,
or TOML with ``[preset.<type>]`` and ``[pin.<archive>]`` tables.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_WORDS = 500
# What archive types do unless a file says otherwise.
PRESETS = {"wikipedia": {"summary_style": "first_section"}, "stackexchange": {"summary_style": "q_and_a", "max_paragraphs": 3}}


def _lines(path: str | Path) -> list[str]:
    text = Path(path).read_text(encoding="utf-8")
    return [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]


def load_misspellings(path: str | Path | None, default: dict[str, str]) -> dict[str, str]:
    """The words of a file of ``wrong=right`` lines, or ``default``; lines of another form are passed over."""
    if path is None:
        return dict(default)
    pairs = (x.lower().partition("=") for x in _lines(path))
    found = {a.strip(): b.strip() for a, sign, b in pairs if sign and a.strip() and b.strip()}
    return dict(list(found.items())[:MOST_WORDS])


def load_exclusions(path: str | Path | None) -> frozenset[str]:
    return frozenset() if path is None else frozenset(x.lower() for x in _lines(path)[:MOST_WORDS])


@dataclass(frozen=True)
class Presets:
    by_type: dict[str, dict] = field(default_factory=lambda: {k: dict(v) for k, v in PRESETS.items()})
    pins: dict[str, dict] = field(default_factory=dict)

    def effective(self, kind: str, confidence: str, name: str) -> dict | None:
        """A pin of the archive over its type's preset; without a pin the preset, if the type is certain."""
        pin = self.pins.get(name)
        if pin is not None:
            own = {k: v for k, v in pin.items() if k != "type"}
            return {**self.by_type.get(pin.get("type") or kind, {}), **own} or None
        return self.by_type.get(kind) if confidence == "high" else None

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(archive, preset) of the pins and (type, preset) of the types, for ``archives.effective_preset``; no Python worker is started."""
        rows = lambda d, key: spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias(key), F.lit(v.get("summary_style", "first_section")).alias("preset")) for k, v in d.items()] or [F.struct(F.lit("").alias(key), F.lit("").alias("preset"))])))
        return rows(self.pins, "archive"), rows(self.by_type, "type")


def load_presets(path: str | Path | None = None) -> Presets:
    """The presets with those of a file merged over them; a file that cannot be read raises."""
    out = Presets()
    if path is None:
        return out
    doc = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    for kind, values in doc.get("preset", {}).items():
        out.by_type[kind] = {**out.by_type.get(kind, {}), **values}
    for name, values in doc.get("pin", {}).items():
        out.pins[name] = {**out.pins.get(name, {}), **values}
    return out
