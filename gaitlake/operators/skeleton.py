"""Skeleton definitions: joints, links between them, and angle triples."""

from __future__ import annotations

import runpy
from dataclasses import dataclass, field
from typing import Any


def _whole(x: object) -> int:
    """A joint number out of whatever a file holds; an error if it is none that 16 bits take."""
    if int(x) != x or not 0 <= int(x) < 1 << 16:
        raise ValueError(f"{x} is no joint number")
    return int(x)


@dataclass(frozen=True)
class Skeleton:
    """Joint names with the pairs and triples of joint numbers that features are made of."""

    joints: tuple[str, ...]
    links: tuple[tuple[int, int], ...]
    angles: tuple[tuple[int, int, int], ...] | None = None
    colors: tuple[tuple[float, ...], ...] = ()
    joint_colors: tuple[tuple[float, ...], ...] | None = None
    index: dict[str, int] = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        n = len(self.joints)
        for name, kind in (("links", _whole), ("angles", _whole), ("colors", float), ("joint_colors", float)):
            held = getattr(self, name)
            if held is not None:
                object.__setattr__(self, name, tuple(tuple(kind(x) for x in group) for group in held))
        for group in (*self.links, *(self.angles or ())):
            if not all(0 <= j < n for j in group):
                raise ValueError(f"{group} names a joint beyond the {n} there are")
        object.__setattr__(self, "index", {name: k for k, name in enumerate(self.joints)})


def skeleton_from_config(config: dict[str, Any]) -> Skeleton:
    """From a mapping with LABELS, SEGMENTS, COLORS, KEYPT_COLORS and, if need be, JOINT_ANGLES."""
    tuples = lambda key: tuple(tuple(x) for x in config[key])
    return Skeleton(tuple(config["LABELS"]), tuples("SEGMENTS"), tuples("JOINT_ANGLES") if config.get("JOINT_ANGLES") else None, tuples("COLORS"), tuples("KEYPT_COLORS"))


def skeleton_from_module(path: str, name: str) -> Skeleton:
    """The skeleton called ``name`` of a Python file that defines presets as mappings by name; the file is run, so it must be trusted."""
    held = runpy.run_path(path)
    # The names of the mappings.
    joints, colors, links, angles = (held[key].get(name) for key in ("JOINT_NAME_DICT", "COLOR_DICT", "CONNECTIVITY_DICT", "JOINT_ANGLES_DICT"))
    if joints is None or links is None:
        raise ValueError(f"{path} has no skeleton {name}")
    return Skeleton(tuple(joints), tuple(map(tuple, links)), tuple(map(tuple, angles)) if angles is not None else None, tuple(map(tuple, colors)) if colors is not None else ())


# The 18-joint mouse skeleton that pose data of this kind comes with.
MOUSE18 = Skeleton(
    joints=("Snout", "EarR", "EarL", "SpineF", "SpineM", "Tail_base", "ForepawR", "WristR", "ElbowR", "ForepawL", "WristL", "ElbowL", "HindpawR", "AnkleR", "KneeR", "HindpawL", "AnkleL", "KneeL"),
    links=((0, 1), (1, 3), (0, 2), (2, 3), (2, 1), (0, 3), (4, 3), (5, 4), (6, 7), (7, 8), (8, 3), (9, 10), (10, 11), (11, 3), (12, 13), (13, 14), (14, 5), (15, 16), (16, 17), (17, 5)),
    angles=(
        (0, 1, 3), (0, 2, 3), (0, 3, 4), (1, 3, 4), (2, 3, 4), (3, 4, 5), (1, 3, 8), (2, 3, 8), (0, 3, 8), (3, 8, 7), (8, 7, 6), (1, 3, 11), (2, 3, 11), (0, 3, 11), (3, 11, 10), (11, 10, 9),
        (4, 5, 14), (5, 14, 13), (14, 13, 12), (4, 5, 17), (5, 17, 16), (17, 16, 15), (0, 3, 6), (0, 3, 7), (0, 3, 9), (0, 3, 10), (4, 5, 12), (4, 5, 13), (4, 5, 15), (4, 5, 16),
    ),
)
