"""Globs as anchored regular expressions, one function a dialect; run on the driver, once a pattern."""

from __future__ import annotations

import re


def _compiled(pattern: str, star: str, double: str, double_dir: str | None) -> str:
    """A glob over portable paths; double_dir is what ``**/`` stands for, if it is more than a double star and a slash."""
    parts, i = [], 0
    for token in re.findall(r"\*\*/|\*\*|.", pattern.replace("\\", "/"), re.DOTALL):
        if token == "**/":
            parts.append(double_dir if double_dir is not None else double + "/")
        elif token == "**":
            parts.append(double)
        else:
            parts.append({"*": star, "?": "[^/]"}.get(token) or re.escape(token))
    return "^" + "".join(parts) + "$"


def path_glob(pattern: str) -> str:
    """For finding and searching: a star stays within a path part, two stars are as one."""
    return _compiled(re.sub(r"\*+", "*", pattern), "[^/]*", "[^/]*", None)


def rule_glob(pattern: str) -> str:
    """For rules: two stars and a slash are any number of directories, none too; two stars are anything."""
    return _compiled(pattern, "[^/]*", ".*", "(?:.*/)?")


def mapping_glob(pattern: str) -> str:
    """For test mappings: two stars are anything, so ``**/core/**`` needs a directory before core."""
    return _compiled(pattern, "[^/]*", ".*", None)


def name_glob(pattern: str) -> str:
    """As shells match names: a star crosses slashes."""
    return _compiled(re.sub(r"\*+", "*", pattern), ".*", ".*", None).replace("[^/]", ".")
