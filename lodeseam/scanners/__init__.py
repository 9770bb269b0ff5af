"""Scanners: functions from a buffer of bytes to features, carved objects and further buffers.

A scanner takes a Page and yields Found, Carved and Child values; offsets count from the buffer's start. Scanners know
nothing of Spark; plans.scan runs all wanted ones over each page in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from importlib.metadata import entry_points

API_VERSION = 1


@dataclass(frozen=True)
class Page:
    """A buffer; `size` bytes are its own, what follows is look-ahead that the next page owns."""

    buf: bytes
    size: int
    path: str = ""
    offset: int = 0
    depth: int = 0
    memory: bool = False
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Found:
    recorder: str
    at: int
    feature: bytes | str
    length: int | None = None  # bytes of the buffer that the feature takes, for its context
    context: str | None = None
    utf16: bool = False


@dataclass(frozen=True)
class Carved:
    recorder: str
    at: int
    ext: str
    data: bytes


@dataclass(frozen=True)
class Child:
    tag: str
    at: int
    data: bytes
    memory: bool = False


@dataclass(frozen=True)
class Scanner:
    name: str
    run: Callable[[Page], Iterator]
    default: bool = True
    depth0_only: bool = False
    min_size: int = 16
    min_distinct: int = 4
    #: False: a buffer that this decoder made is not given to it again.
    again: bool = True


REGISTRY: dict[str, Scanner] = {}


def scanner(name: str, **options):
    """Registers a function as a scanner."""

    def add(f: Callable[[Page], Iterator]):
        REGISTRY[name] = Scanner(name, f, **options)
        return f

    return add


def load_plugins(group: str = "lodeseam.scanners") -> list[str]:
    """Scanners that installed distributions offer under an entry point; each must be a Scanner."""
    names = []
    for point in sorted(entry_points(group=group), key=lambda p: p.name):
        made = point.load()
        if isinstance(made, Scanner):
            REGISTRY[made.name] = made
            names.append(made.name)
    return names


def enabled(enable: tuple[str, ...] = (), disable: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> list[Scanner]:
    """The scanners of a run: the default ones, less those disabled ("all": all), plus those enabled; or only some."""
    for name in {*enable, *disable, *only} - {"all"} - set(REGISTRY):
        raise KeyError(f"no scanner is called {name}")
    if only:
        chosen = set(only)
    else:
        chosen = {n for n, s in REGISTRY.items() if s.default}
        chosen -= set(REGISTRY) if "all" in disable else set(disable)
        chosen |= set(REGISTRY) if "all" in enable else set(enable)
    return [s for n, s in REGISTRY.items() if n in chosen]


from . import binary, carve, decode, textual  # noqa: E402, F401
