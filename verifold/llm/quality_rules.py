"""Line-first cleaning of documents.

Each ``\\n``-split line is judged by three families of rules; failing lines are removed, and a
document that loses too large a share of its words is rejected whole.

Defined results: a null or empty text has no words and fails the base rule (fewer than 20
words); null doc_ids pass through; repeated rows are judged one by one; other columns are
never read.  A document is judged by itself, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
NAVIGATION_SEPARATORS = frozenset("| > » › · • / « ‹".encode().split())
NAVIGATION_WORDS = frozenset(
    b"home menu login logout register next previous prev back top search share tweet print help contact about sitemap faq more".split()
)
BOILERPLATE = re.compile(
    rb"cookie|privacy policy|terms of (?:use|service)|all rights reserved|subscribe to|sign up for|click here|enable javascript|lorem ipsum|"
    rb"licensed under|released under the|powered by|copyright \(c\)",
)
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Marks that end or divide a sentence, in UTF-8.
CLAUSE = re.compile(rb"[.,;:!?]|\xe2\x80\xa6|\xe3\x80\x82")


@dataclass(frozen=True)
class Rules:
    max_punctuation: float = 0.15  # of a line's characters that are not spaces
    min_punctuation: int = 4  # marks, below which that share isn't judged
    min_clause_words: int = 25  # a line of so many words has a mark between or after them
    max_navigation: float = 0.2  # of a line's words that are separators or menu words
    max_stutter: float = 0.5  # of a line's words that repeat the word before
    max_boilerplate_words: int = 30  # a longer line that names such a phrase is prose
    max_lost: float = 0.6  # of a document's words in removed lines


def judge_line(line: bytes, words: list[bytes], rules: Rules) -> str | None:
    """The first rule that the line fails, or None.  A line without words fails nothing."""
    n = len(words)
    if not n:
        return None
    dense = sum(map(len, words))
    marks = dense - len(line.translate(None, PUNCTUATION + b" \t\n\v\f\r"))
    if marks >= rules.min_punctuation and marks > rules.max_punctuation * dense:
        lone = sum(w in NAVIGATION_SEPARATORS for w in words)
        return "navigation" if lone >= 2 and lone > rules.max_navigation * n else "punctuation"
    if n >= rules.min_clause_words and not CLAUSE.search(line):
        return "punctuation"
    if marks >= 2 or n <= 12:
        menu = sum(w in NAVIGATION_SEPARATORS for w in words)
        if menu >= 2 or n <= 12:
            menu += sum(w.lower().strip(b".,:;") in NAVIGATION_WORDS for w in words)
        if menu >= 2 and menu > rules.max_navigation * n:
            return "navigation"
    if n >= 4 and sum(map(bytes.__eq__, words, words[1:])) > rules.max_stutter * (n - 1):
        return "boilerplate"
    if n <= rules.max_boilerplate_words and BOILERPLATE.search(line.lower()):
        return "boilerplate"
    return None


def clean(text: bytes, rules: Rules = Rules()) -> tuple[bytes, int, dict[str, int]]:
    """The text without failing lines, the words lost with them, and failing lines by rule."""
    stay, lost, why = [], 0, {}
    for line in text.split(b"\n"):
        words = line.split()
        if (rule := judge_line(line, words, rules)) is None:
            stay.append(line)
        else:
            lost += len(words)
            why[rule] = why.get(rule, 0) + 1
    return b"\n".join(stay), lost, why


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of that width that occur twice or more.

    Exact: windows are numbered by doubling (pairs, fours, eights) with one sort each, and a
    text whose pairs are all different ends at once.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    code = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    step = 1
    while step < width:
        code = code[:-step] * (int(code.max()) + 1) + code[step:]
        values, code = np.unique(code, return_inverse=True)
        if len(values) == len(code):
            return 0
        step *= 2
    twice = np.bincount(code)[code] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def base(text: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    points = len(text) - sum(map(text.count, SPACES.encode())) - (0 if text.isascii() else int((np.frombuffer(text, np.uint8) & 0xC0 == 0x80).sum()))
    symbols = sum(map(text.count, (c.encode() for c in SYMBOLS)))
    lines = text.split(b"\n")
    dup = 0
    if len(set(lines)) < len(lines):
        earlier: set[bytes] = set()
        for line in lines:
            if line and not line.isspace():
                dup += line in earlier
                earlier.add(line)
    return points, symbols, dup, repeated_words(words)


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "lost_words long, failed_punctuation long, failed_navigation long, failed_boilerplate long"
)


def apply(docs: DataFrame, rules: Rules = Rules(), with_text: bool = False) -> DataFrame:
    """One row per document of ``docs(doc_id, text)`` with its measures and verdict; with_text adds clean_text."""
    arrow = pa.schema([(x.split()[0], pa.bool_() if x.endswith("boolean") else pa.int64()) for x in SCHEMA.split(", ")] + [("clean_text", pa.string())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in common.texts(batch):
                words = text.split()
                n = len(words)
                points, symbols, dup, repeat = base(text, words)
                stay, lost, why = clean(text, rules)
                failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
                kept = not failed and lost <= rules.max_lost * n
                rows.append((n, points, symbols, dup, repeat, failed, kept, lost, *(why.get(k, 0) for k in ("punctuation", "navigation", "boilerplate")), *[stay] * with_text))
            columns = list(zip(*rows, strict=True)) or [()] * (len(arrow) - 1)
            arrays = [pa.array(c, pa.binary()).cast(f.type) if f.name == "clean_text" else pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *arrays], schema=arrow)

    return common.map_batches(docs.select("doc_id", "text"), run, SCHEMA + ", clean_text string" * with_text)


def keep(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of documents that pass, with their failing lines removed from text and n_chars (if there is one) counted anew.

    The verdict is computed beside the row in one pass: no join, so repeated or null ids stay
    themselves.  Null and empty texts fail; other columns are unchanged.
    """
    schema = docs.schema
    at, size = schema.names.index("text"), schema.names.index("n_chars") if "n_chars" in schema.names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, cleaned = [], []
            for value in batch.column(at).cast(pa.binary()).to_pylist():
                text = value or b""
                words = text.split()
                n = len(words)
                passes = n >= MIN_WORDS and 100 * repeated_words(words) <= MAX_REPEAT_PERCENT * n
                stay, lost, _ = clean(text, rules) if passes else (b"", 0, {})
                mask.append(passes and lost <= rules.max_lost * n)
                if mask[-1]:
                    cleaned.append(stay)
            batch = batch.filter(pa.array(mask, pa.bool_()))
            texts = pa.array(cleaned, pa.binary()).cast(pa.string())
            columns = [texts if i == at else pc.utf8_length(texts).cast(c.type) if i == size else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return common.map_batches(docs, run, schema)
