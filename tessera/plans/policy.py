"""Policies and declarations of sources, and the protocol checks over their manifests."""

from __future__ import annotations

from dataclasses import dataclass, field


class BrokenProtocol(ValueError):
    """Manifests show that a fit saw what it must not, or that artifacts do not belong together."""


@dataclass(frozen=True)
class SourcePolicy:
    """How a source is built and used; later settings override earlier ones."""

    name: str
    out_of_fold: bool = True
    uses_labels: bool = False
    max_candidates: int | None = None
    min_score: float | None = None
    score_field: str = "score"


def resolve(name: str, *settings: dict) -> SourcePolicy:
    merged: dict = {}
    for s in settings:
        merged |= {k: v for k, v in s.items() if k in SourcePolicy.__dataclass_fields__ and k != "name"}
    return SourcePolicy(name, **merged)


@dataclass(frozen=True)
class FitScope:
    """What an artifact was fitted on."""

    splits: tuple[str, ...] = ()
    labels: bool = False
    fold_policy: str = "none"
    devset: bool = False
    blind: bool = False
    excluded_folds: tuple[int, ...] = field(default=())


def compose(scopes: list[FitScope]) -> FitScope:
    """The scope of a union: any flag of a part, all splits."""
    policies = {s.fold_policy for s in scopes}
    return FitScope(
        tuple(sorted({x for s in scopes for x in s.splits})), any(s.labels for s in scopes), policies.pop() if len(policies) == 1 else "mixed",
        any(s.devset for s in scopes), any(s.blind for s in scopes), tuple(sorted({f for s in scopes for f in s.excluded_folds})),
    )


def check_scope(scope: FitScope, target: str) -> None:
    """A fit that used labels of the rows it is evaluated on is refused, unless their own fold was left out."""
    if scope.labels and target == "devset" and scope.devset and scope.fold_policy != "out_of_fold":
        raise BrokenProtocol("the devset is part of the fit")
    if scope.blind and scope.labels:
        raise BrokenProtocol("blind rows have no labels to fit on")


def check_union(manifest: dict, sources: list[str], folds: set[int] | None = None) -> None:
    """The union's manifest lists these sources in this order, and its folds are complete."""
    if list(manifest.get("sources", [])) != list(sources):
        raise BrokenProtocol(f"sources {manifest.get('sources')} where {sources} were declared")
    if folds is not None and set(manifest.get("folds", [])) != folds:
        raise BrokenProtocol(f"folds {sorted(manifest.get('folds', []))} where {sorted(folds)} are wanted")


def check_parity(configs: list[dict]) -> None:
    """Union settings agree on the order, caps and least scores of their sources."""
    shape = lambda c: [(s["name"], s.get("max_candidates"), s.get("min_score")) for s in c["sources"]]
    if any(shape(c) != shape(configs[0]) for c in configs[1:]):
        raise BrokenProtocol("settings differ in their sources, caps or least scores")


def split_name(manifest: dict, path: str) -> str:
    """The split that a manifest names, else the name of its folder."""
    return str(manifest.get("split") or path.rstrip("/").rsplit("/", 1)[-1])


def check_keys(expected: list[str], found: list[str]) -> None:
    """Two artifacts hold the same keys in the same order."""
    for i, (a, b) in enumerate(zip(expected, found)):
        if a != b:
            raise BrokenProtocol(f"row {i} is {b!r} where {a!r} was expected")
    if len(expected) != len(found):
        raise BrokenProtocol(f"{len(found)} rows where {len(expected)} were expected")


def source_path(root: str, source: dict, target: str) -> str:
    """Where a source of the union lies: its own path for the target, else by component, configuration and mode, which the target sets by default."""
    paths = source.get("paths") or {}
    if target in paths:
        return paths[target]
    mode = source.get("mode") or ("oof" if target == "devset" and resolve(source["name"], source).out_of_fold else "full")
    return f"{root}/{source.get('stage', 'retriever')}/{source['name']}/{source.get('config', 'default')}/{mode}/{target}"


def decorated(source: dict, union: dict) -> SourcePolicy:
    """A source's policy with the cap, least score and score field that the union's settings give it."""
    own = next((s for s in union.get("sources", []) if s.get("name") == source["name"]), {})
    return resolve(source["name"], source, own)


def width(setting: str | int | None, default: int = 500) -> int:
    """Candidates a reranker takes per row: all, full and none mean every one, as 0."""
    if setting is None:
        return default
    return 0 if str(setting).lower() in ("all", "full", "none") else int(setting)
