"""Opaque cursors of keyset pagination."""

from __future__ import annotations

import base64
import binascii
import json
import re
from dataclasses import dataclass

from ..schema import bad

VERSION = 1


@dataclass(frozen=True)
class Cursor:
    us: int
    id: int

    def encode(self) -> str:
        raw = json.dumps({"v": VERSION, "t": self.us, "i": str(self.id)}, separators=(",", ":"))
        return base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")

    @classmethod
    def decode(cls, text: str) -> Cursor:
        try:
            if len(text) > 512 or not re.fullmatch(r"[A-Za-z0-9_-]+", text):
                raise ValueError
            x = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
            if not isinstance(x, dict) or x.get("v") != VERSION or type(x.get("t")) is not int or abs(x["t"]) > 2**53 - 1:
                raise ValueError
            if not isinstance(x.get("i"), str) or not re.fullmatch(r"[0-9]{1,19}", x["i"]) or int(x["i"]) > 2**63 - 1:
                raise ValueError
        except (ValueError, binascii.Error, UnicodeDecodeError):
            raise bad("invalid cursor") from None
        return cls(x["t"], int(x["i"]))
