"""Motif selection and resolution by name, on the driver: a motif list is small."""

from __future__ import annotations

import re


def _matches(names: list[str], query: str) -> list[int]:
    """Exact, else by prefix up to a dot or underscore, else by part, without regard to case in the last."""
    for test in (lambda n: n == query, lambda n: n.startswith((f"{query}.", f"{query}_")), lambda n: query.lower() in n.lower()):
        if found := [i for i, n in enumerate(names) if test(n)]:
            return found
    return []


def select_motifs(names: list[str], spec: str) -> list[int]:
    """Indices for ``0-3,CTCF,7``: inclusive ranges, indices and names, each once, in the order given."""
    out: list[int] = []
    for token in (t.strip() for t in spec.split(",")):
        if not token:
            continue
        if m := re.fullmatch(r"(\d+)-(\d+)", token):
            a, b = int(m[1]), int(m[2])
            if b < a:
                raise ValueError(f"descending range {token}")
            found = list(range(a, b + 1))
        elif token.isdigit():
            found = [int(token)]
        else:
            found = _matches(names, token)
        if not found or found[-1] >= len(names):
            raise ValueError(f"no motif for {token!r}")
        out += found
    if not out:
        raise ValueError("no motif selected")
    return list(dict.fromkeys(out))


def resolve_motif(names: list[str], query: str) -> int:
    """The one motif that an index or name stands for."""
    if query.isdigit():
        if int(query) >= len(names):
            raise ValueError(f"no motif {query}")
        return int(query)
    found = _matches(names, query)
    if len(found) != 1:
        raise ValueError(f"{query!r} stands for {len(found)} motifs")
    return found[0]


def resolve_target(names: list[str], target: str, resolver=None) -> int:
    """Digits are an index, anything else goes to the resolver (name -> index), which is resolve_motif unless given."""
    if target.isdigit():
        return resolve_motif(names, target)
    return (resolver or (lambda t: resolve_motif(names, t)))(target)


def thresholds_of(n: int, key: str | None = None, score: float | None = None, by_key: dict[str, list[float]] | None = None, annotation: list[float] | None = None) -> list[float]:
    """Thresholds of n motifs: an explicit score, else those of the p-value key, else the annotation's.

    None of them, or a list of another length: ValueError.
    """
    if score is not None:
        return [float(score)] * n
    out = (by_key or {}).get(key) if key is not None else None
    out = annotation if out is None else out
    if out is None or len(out) != n:
        raise ValueError("no threshold for every motif")
    return [float(x) for x in out]
