"""Plain Python values: JSON in text, addresses in nested results, settings from the environment."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping
from typing import Any

from .text import URL_PATTERN

_CLOSING = ".,;:)]}>"
#: Keys whose text is an address as a whole.
URL_KEYS = {"url", "href", "link", "source"}


def json_in(text: str | None) -> dict | list:
    """The JSON object or array that begins at the first bracket of a text; ``ValueError`` if there is none or it is broken."""
    found = re.search(r"[{\[]", text or "")
    if not found:
        raise ValueError("no JSON in the text")
    value, _ = json.JSONDecoder().raw_decode(text, found.start())
    return value


def json_object(text: str | None) -> dict:
    value = json_in(text)
    if not isinstance(value, dict):
        raise ValueError("expected a JSON object")
    return value


def json_array(text: str | None) -> list:
    value = json_in(text)
    if not isinstance(value, list):
        raise ValueError("expected a JSON array")
    return value


def json_anywhere(text: str | None) -> Any:
    """JSON of a text that may have a fence or prose around it: the whole, a fenced block, or what any bracket begins; else null."""
    text = (text or "").strip()
    fenced = re.findall(r"```(?:\w+)?\s*(.*?)```", text, re.DOTALL)
    starts = [text[m.start() :] for m in re.finditer(r"[{\[]", text)]
    for part in [text, *fenced, *starts]:
        try:
            return json.JSONDecoder().raw_decode(part.strip())[0]
        except ValueError:
            continue
    return None


def _found(value: Any) -> Iterator[str]:
    if isinstance(value, str):
        yield from re.findall(URL_PATTERN, value)
    elif isinstance(value, Mapping):
        for key, own in value.items():
            if str(key).lower() in URL_KEYS and isinstance(own, str):
                yield own.strip()
            else:
                yield from _found(own)
    elif isinstance(value, list):
        for own in value:
            yield from _found(own)


def urls_in(value: Any) -> list[str]:
    """Distinct addresses of a nested value in order, without closing punctuation."""
    return [u for u in dict.fromkeys(u.rstrip(_CLOSING) for u in _found(value)) if u]


def flag(value: str | None, default: bool = False) -> bool:
    """A setting that is on or off."""
    return default if value is None or not value.strip() else value.strip().lower() in ("1", "true", "yes", "on")


def listed(value: str | None) -> list[str]:
    """A setting with commas between its parts."""
    return [x.strip() for x in (value or "").split(",") if x.strip()]


def endpoint(base: str, path: str) -> str:
    """An address below a base that may or may not end in ``/v1``."""
    base = base.strip().rstrip("/")
    return f"{base if base.endswith('/v1') else base + '/v1'}/{path.lstrip('/')}"
