"""Staged files of the driver: listing by prefix, templates, and removal of what one item left."""

from __future__ import annotations

from pathlib import Path


def listed(folder: str, prefix: str) -> list[str]:
    """Names in ``folder`` that start with ``prefix``; none if the folder isn't there."""
    at = Path(folder)
    return sorted(p.name for p in at.iterdir() if p.name.startswith(prefix)) if at.is_dir() else []


def drop_staged(folder: str, item: str) -> list[str]:
    """Remove the files of one item, ``item`` or ``item.<anything>``; those of ``item0`` stay."""
    own = [n for n in listed(folder, item) if n == item or n.startswith(f"{item}.")]
    for n in own:
        (Path(folder) / n).unlink()
    return own


def template(path: str) -> str:
    return Path(path).read_text()


def stage(folder: str, item: str, text: str) -> str:
    """Write an item's program where :func:`drop_staged` finds it; the folder is made if needed."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    drop_staged(folder, item)
    out = Path(folder) / f"{item}.txt"
    out.write_text(text)
    return str(out)
