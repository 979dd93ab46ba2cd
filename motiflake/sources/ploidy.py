"""Ploidy configurations: bundled ones by name, or a JSON file that is checked before use."""

from __future__ import annotations

import json
import re

# The bundled configurations and their aliases.
_XX = {"default": 2, "overrides": {"(chr)?Y": 0, "(chr)?M": 1}}
_XY = {"default": 2, "overrides": {"(chr)?X": 1, "(chr)?Y": 1, "(chr)?M": 1}}
CONFIGS = {
    "haploid": {"default": 1},
    "diploid_autosomes": {"default": 2, "ignore": ["chr(X|Y)"], "overrides": {"(chr)?M": 1}},
    "diploid_xx": _XX,
    "XX": _XX,
    "diploid_xy": _XY,
    "XY": _XY,
}


def checked(config: object) -> dict:
    """The configuration, if it is one; ValueError says what is wrong."""
    if not isinstance(config, dict) or set(config) - {"default", "overrides", "ignore"}:
        raise ValueError("a ploidy configuration has default, overrides and ignore only")
    if not isinstance(config.get("default"), int) or isinstance(config.get("default"), bool):
        raise ValueError("default has to be a whole number")
    if not isinstance(config.get("overrides", {}), dict) or not all(isinstance(v, int) for v in config.get("overrides", {}).values()):
        raise ValueError("overrides maps patterns to whole numbers")
    if not isinstance(config.get("ignore", []), list):
        raise ValueError("ignore is a list of patterns")
    for pattern in [*config.get("overrides", {}), *config.get("ignore", [])]:
        re.compile(pattern)
    return config


def load(name_or_path: str) -> dict:
    if name_or_path in CONFIGS:
        return CONFIGS[name_or_path]
    with open(name_or_path) as f:
        return checked(json.load(f))


def copies(contig: str, config: dict) -> int | None:
    """The ploidy of one contig."""
    for pattern, n in config.get("overrides", {}).items():
        if re.fullmatch(pattern, contig):
            return n
    return None if any(re.fullmatch(p, contig) for p in config.get("ignore", [])) else config["default"]
