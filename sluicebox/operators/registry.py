"""Detector bundles and an append-only registry: an event log whose fold is the state."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from .rules import RULESET_VERSION, Thresholds

#: Promotion gate: flag rate on test against budget, worst benign rate, and share of rule-shaped targets found. Fixed values.
MAX_RATE_RATIO = 2.0
MAX_BENIGN_RATE = 0.10
MIN_SCOPE_RATE = 0.90


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def bundle_of_rules(t: Thresholds = Thresholds()) -> dict:
    """A bundle whose id follows from its content."""
    body = {"family": "rules", "ruleset_version": RULESET_VERSION, "thresholds": asdict(t)}
    return body | {"detector_id": "rules-" + digest(json.dumps(body, sort_keys=True).encode())[:16]}


def bundle_of_forest(model_json: str, threshold: float, evidence: dict, columns: Iterable[str], grid: dict | None = None) -> dict:
    body = {"family": "forest", "columns": list(columns), "threshold": threshold, "evidence": evidence, "model_sha256": digest(model_json.encode()), "reference_grid": grid or {}}
    return body | {"detector_id": "forest-" + digest(json.dumps(body, sort_keys=True).encode())[:16]}


def write_bundle(folder: Path, bundle: dict, model_json: str | None = None) -> Path:
    target = Path(folder) / bundle["detector_id"]
    target.mkdir(parents=True)
    if model_json is not None:
        (target / "model.json").write_text(model_json, encoding="utf-8")
    (target / "bundle.json").write_text(json.dumps(bundle, sort_keys=True, indent=2) + "\n", encoding="utf-8")
    return target


def unchanged(bundle: dict) -> bool:
    """Whether a bundle's id still follows from its content."""
    body = {k: v for k, v in bundle.items() if k != "detector_id"}
    return bundle.get("detector_id", "").endswith(digest(json.dumps(body, sort_keys=True).encode())[:16])


def load_bundle(folder: Path, columns: Iterable[str] | None = None) -> tuple[dict, str | None]:
    """A bundle and its model; ValueError if either was changed or the model's columns aren't these."""
    folder = Path(folder)
    bundle = json.loads((folder / "bundle.json").read_text(encoding="utf-8"))
    if not unchanged(bundle):
        raise ValueError("the bundle was changed after it was made")
    if bundle["family"] != "forest":
        return bundle, None
    model = (folder / "model.json").read_text(encoding="utf-8")
    if digest(model.encode()) != bundle["model_sha256"]:
        raise ValueError("the model is not the one of the bundle")
    if columns is not None and list(columns) != bundle["columns"]:
        raise ValueError("the model was made for other columns")
    return bundle, model


def failures(bundle: dict) -> list[str]:
    """Why a bundle may not be promoted; empty if it may. Rules pass: they have no rates of their own."""
    if bundle["family"] == "rules":
        return []
    e = bundle["evidence"]
    tests = {
        "test flag rate": e.get("rate_ratio") is not None and e["rate_ratio"] <= MAX_RATE_RATIO,
        "benign controls": e.get("worst_benign_rate") is not None and e["worst_benign_rate"] <= MAX_BENIGN_RATE,
        "rule scope": e.get("rule_scope_rate") is not None and e["rule_scope_rate"] >= MIN_SCOPE_RATE,
        "determinism": bool(e.get("deterministic")),
    }
    return [name for name, passed in tests.items() if not passed]


@dataclass
class State:
    registered: list[str] = field(default_factory=list)
    champion: str | None = None
    previous: list[str] = field(default_factory=list)


def fold(events: Iterable[dict]) -> State:
    """The state after a log: promotions stack up, a rollback takes the last one off."""
    s = State()
    for e in events:
        if e["kind"] == "registered" and e["detector_id"] not in s.registered:
            s.registered.append(e["detector_id"])
        elif e["kind"] == "promoted":
            if s.champion:
                s.previous.append(s.champion)
            s.champion = e["detector_id"]
        elif e["kind"] == "rolled_back":
            s.champion = s.previous.pop() if s.previous else None
    return s


class Registry:
    """One JSON line per event."""

    def __init__(self, path: Path):
        self.path = Path(path)

    def events(self) -> list[dict]:
        if not self.path.exists():
            return []
        return [json.loads(line) for line in self.path.read_text(encoding="utf-8").splitlines() if line.strip()]

    @property
    def state(self) -> State:
        return fold(self.events())

    def _append(self, **event) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.path.open("a", encoding="utf-8") as f:
            f.write(json.dumps(event, sort_keys=True) + "\n")

    def register(self, bundle: dict) -> None:
        if bundle["detector_id"] in self.state.registered:
            raise ValueError("this bundle is registered already")
        self._append(kind="registered", detector_id=bundle["detector_id"])

    def promote(self, bundle: dict, reason: str) -> None:
        if bundle["detector_id"] not in self.state.registered:
            raise ValueError("register the bundle first")
        if not unchanged(bundle):
            raise ValueError("the bundle was changed after it was made")
        if bundle["detector_id"] == self.state.champion:
            raise ValueError("this bundle is the champion already")
        if wrong := failures(bundle):
            self._append(kind="refused", detector_id=bundle["detector_id"], reason=reason, failed=wrong)
            raise ValueError("not promoted: " + ", ".join(wrong))
        self._append(kind="promoted", detector_id=bundle["detector_id"], reason=reason)

    def rollback(self, reason: str, bundles: Path | None = None) -> str:
        """Back to the champion before. bundles: the folder of bundles; the one to go back to is then loaded and must be
        whole and still pass, else nothing changes."""
        s = self.state
        if not s.previous:
            raise ValueError("there is no earlier champion")
        if bundles is not None:
            bundle, _ = load_bundle(Path(bundles) / s.previous[-1])
            if bundle["detector_id"] != s.previous[-1] or (wrong := failures(bundle)):
                raise ValueError("the earlier champion may not serve: " + ", ".join(wrong if bundle["detector_id"] == s.previous[-1] else ["another bundle"]))
        self._append(kind="rolled_back", detector_id=s.champion, to=s.previous[-1], reason=reason)
        return s.previous[-1]
