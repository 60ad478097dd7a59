"""Class selectors: '3', '1,3', '1_3', '2-4', mixtures, numbers and nested lists of these."""

from __future__ import annotations

from collections.abc import Iterable


def parse_selector(value: object) -> tuple[int, ...]:
    """Sorted distinct classes of a selector; () for null and blank. Booleans and falling ranges raise."""
    found: set[int] = set()

    def add(part: object) -> None:
        if part is None:
            return
        if isinstance(part, bool):
            raise ValueError("a class selector can't be a boolean")
        if isinstance(part, int):
            found.add(part)
        elif isinstance(part, str):
            for piece in part.replace("_", ",").split(","):
                if not (piece := piece.strip()):
                    continue
                low, dash, high = piece.partition("-")
                first, last = int(low), int(high) if dash else int(low)
                if last < first:
                    raise ValueError(f"falling range {piece!r}")
                found.update(range(first, last + 1))
        elif isinstance(part, Iterable):
            for inner in part:
                add(inner)
        else:
            raise ValueError(f"not a class selector: {part!r}")

    add(value)
    return tuple(sorted(found))


def canonical_selector(value: object) -> str | None:
    """'1_2_3' form, or null when nothing is selected."""
    classes = parse_selector(value)
    return "_".join(map(str, classes)) if classes else None


def manifest_name(value: object) -> str:
    """File of a selection: one file per exact combination, else the file with all classes."""
    selected = canonical_selector(value)
    return f"train_class_{selected}.jsonl" if selected else "train_with_class.jsonl"
