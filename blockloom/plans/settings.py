"""Settings: values with ${NAME} in them, filled from an environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from string import Template


class _Braced(Template):
    """Names in braces only; a bare $ is text."""

    idpattern = r"(?-i:)(?!)"
    braceidpattern = r"(?a:[_a-zA-Z][_a-zA-Z0-9]*)"


def substitute_env(value: str | None, env: Mapping[str, str] | None = None) -> str | None:
    """value with its known names filled; unknown ones stay as they are."""
    return _Braced(value).safe_substitute(os.environ if env is None else env) if value else value
