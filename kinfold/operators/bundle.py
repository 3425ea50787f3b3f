"""A bundle of models: tree texts, kinds, thresholds and a manifest, checked when opened."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from .models import Ensemble, UnsupportedModel, parse
from .policy import CLASSES

MANIFEST = "manifest.json"
HEADS = ("main", "kind", "direction", "structure")
#: Outputs of each head; the kind head's is the number of kinds.
OUTPUTS = {"main": len(CLASSES), "direction": 1, "structure": 3}


@dataclass
class Bundle:
    heads: dict[str, Ensemble]
    kinds: list[str]
    thresholds: dict[str, float]
    version: str
    notes: dict = field(default_factory=dict)

    def outputs(self) -> list[str]:
        """Names of the scored columns, in their order."""
        return [*(f"p_{c}" for c in CLASSES), "guard", "p_sibling_structure", "p_a_derived", *(f"p_kind_{k}" for k in self.kinds)]


def write(folder: str, heads: dict[str, str], kinds: list[str], thresholds: dict[str, float], version: str, **notes) -> None:
    """Model texts and their manifest; nothing is written unless they open again."""
    _checked({h: parse(t) for h, t in heads.items()}, kinds)
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    for head, text in heads.items():
        (out / f"{head}.txt").write_text(text)
    (out / MANIFEST).write_text(json.dumps({"version": version, "heads": sorted(heads), "kinds": kinds, "classes": list(CLASSES), "thresholds": thresholds, "notes": notes}, ensure_ascii=False))


def _checked(heads: dict[str, Ensemble], kinds: list[str]) -> dict[str, Ensemble]:
    if "main" not in heads or set(heads) - set(HEADS):
        raise UnsupportedModel(f"heads: main and any of {HEADS[1:]}")
    for head, model in heads.items():
        want = len(kinds) if head == "kind" else OUTPUTS[head]
        if model.classes != want:
            raise UnsupportedModel(f"{head} has {model.classes} outputs, not {want}")
    return heads


def read(folder: str, features: list[str] | None = None) -> Bundle:
    """The bundle, if its models fit its manifest and, where given, the feature names."""
    at = Path(folder)
    manifest = json.loads((at / MANIFEST).read_text())
    if tuple(manifest["classes"]) != CLASSES:
        raise UnsupportedModel("the classes are others")
    heads = _checked({h: parse((at / f"{h}.txt").read_text()) for h in manifest["heads"]}, manifest["kinds"])
    for head, model in heads.items():
        unknown = [f for f in model.features if features is not None and f.removeprefix("abs_") not in features]
        if unknown:
            raise UnsupportedModel(f"{head} asks for unknown features {unknown}")
    return Bundle(heads, manifest["kinds"], manifest["thresholds"], manifest["version"], manifest["notes"])
