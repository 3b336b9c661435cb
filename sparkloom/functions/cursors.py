"""Opaque page cursors: a row's key values, sealed with a secret and good until a given time."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

#: How long a cursor is good for unless said otherwise, and the shortest secret that is taken.
HOUR_MS, LEAST_SECRET = 3_600_000, 32


class BadCursor(ValueError):
    """The text is no cursor, was changed or was sealed with another secret."""


class ExpiredCursor(ValueError):
    pass


def _body(data: dict) -> bytes:
    return json.dumps(data, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def _seal(body: bytes, secret: str) -> str:
    if len(secret) < LEAST_SECRET:
        raise ValueError(f"a secret has {LEAST_SECRET} characters at least")
    return base64.urlsafe_b64encode(hmac.new(secret.encode(), body, hashlib.sha256).digest()).decode()


def sealed(values: dict, secret: str, now_ms: int, good_for_ms: int | None = HOUR_MS) -> str:
    """A cursor of JSON values; None for ``good_for_ms`` never expires."""
    data = {"values": values} | ({"until": now_ms + good_for_ms} if good_for_ms is not None else {})
    return base64.urlsafe_b64encode(_body({"data": data, "seal": _seal(_body(data), secret)})).decode().rstrip("=")


def opened(cursor: str, secret: str, now_ms: int) -> dict:
    """The values of a cursor that was not changed and has not expired."""
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        data, seal = found["data"], found["seal"]
        values = data["values"]
    except (ValueError, KeyError, TypeError) as wrong:
        raise BadCursor("no cursor") from wrong
    if not isinstance(seal, str) or not hmac.compare_digest(seal.encode(), _seal(_body(data), secret).encode()):
        raise BadCursor("the cursor's seal is broken")
    if data.get("until") is not None and now_ms > data["until"]:
        raise ExpiredCursor("the cursor has expired")
    return values
