"""Objects by dotted path, for settings that name a function or a class."""

from __future__ import annotations

import pkgutil
from collections.abc import Callable


def named_object(path: str, fits: Callable[[object], bool] = callable):
    """What ``package.module.name`` stands for; ValueError if there is no such thing or ``fits`` says no."""
    if "." not in path.strip("."):
        raise ValueError(f"{path!r} has no module")
    try:
        found = pkgutil.resolve_name(path)
    except (ImportError, AttributeError, ValueError) as missing:
        raise ValueError(f"nothing is named {path!r}: {missing}") from missing
    if not fits(found):
        raise ValueError(f"{path!r} is a {type(found).__name__}, which does not fit")
    return found


def named_class(path: str) -> type:
    return named_object(path, lambda x: isinstance(x, type))
