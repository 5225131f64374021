"""Reading replies that are nearly JSON: a tolerant recursive-descent reader as a vectorised UDF.

Fences, reasoning tags and bullets are skipped; keys and values may be bare; commas and closing
brackets may be missing; a reply that breaks off keeps what it said.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import types as Ty
from pyspark.sql.functions import pandas_udf

NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?")
KEY = re.compile(r"[-*\s]*[\"']?([A-Za-z_]\w*)[\"']?\s*:\s*")
WORDS = {"true": True, "false": False, "null": None, "none": None}


class Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def skip(self, more: str = "") -> None:
        while self.at < len(self.text) and (self.text[self.at].isspace() or self.text[self.at] in more):
            self.at += 1

    def string(self, quote: str) -> str:
        self.at += 1
        out = []
        while self.at < len(self.text) and self.text[self.at] != quote:
            c = self.text[self.at]
            if c == "\\" and self.at + 1 < len(self.text):
                self.at += 1
                c = {"n": "\n", "t": "\t", "r": "\r"}.get(self.text[self.at], self.text[self.at])
            out.append(c)
            self.at += 1
        self.at += 1
        return "".join(out)

    def value(self, in_list: bool = False):
        self.skip()
        if self.at >= len(self.text):
            return None
        c = self.text[self.at]
        if c == "{":
            self.at += 1
            return self.members("}")
        if c == "[":
            self.at += 1
            return self.items()
        if c in "\"'":
            return self.string(c)
        end = re.compile(r"[,\]\n]" if in_list else r"[,}\n]").search(self.text, self.at)
        bare = self.text[self.at : end.start() if end else len(self.text)].strip()
        self.at = end.start() if end else len(self.text)
        if bare.lower() in WORDS:
            return WORDS[bare.lower()]
        return json.loads(bare) if NUMBER.fullmatch(bare) else bare

    def items(self) -> list:
        out = []
        while True:
            self.skip(",")
            if self.at >= len(self.text) or self.text[self.at] == "]":
                self.at += 1
                return out
            out.append(self.value(in_list=True))

    def members(self, close: str = "") -> dict:
        out: dict = {}
        while True:
            self.skip(",")
            if self.at >= len(self.text) or self.text[self.at] == close:
                self.at += 1
                return out
            if key := KEY.match(self.text, self.at):
                self.at = key.end()
                out[key[1].lower()] = self.value()
            else:  # what is no member is passed over, to the line's end at most
                stop = self.text.find("\n", self.at)
                brace = self.text.find(close, self.at) if close else -1
                self.at = min((x for x in (stop, brace) if x >= 0), default=len(self.text)) or len(self.text)
                if self.at < len(self.text) and self.text[self.at] == "\n":
                    self.at += 1


def loose(text: str | None) -> dict | None:
    """The object that a reply holds, keys in lower case; None if it has no member."""
    bare = re.sub(r"(?is)<think>.*?</think>", "", text or "")
    bare = re.sub(r"(?i)```(?:json)?|^\s*json\s*$", "", bare).strip()
    start = bare.find("{")
    reader = Reader(bare[start:] if start >= 0 else bare)
    return (reader.value() if start >= 0 else reader.members()) or None


@pandas_udf(Ty.StringType())
def loose_json(text: pd.Series) -> pd.Series:
    """Strict JSON text of ``loose``; null where there is none."""
    return text.map(lambda t: None if (o := loose(t)) is None else json.dumps(o, ensure_ascii=False))
