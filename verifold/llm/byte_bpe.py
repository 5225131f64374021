"""Byte-level BPE, encoding and decoding, by DuckDB recursive queries inside each partition.

A text is cut by the split pattern; the distinct words that a worker hasn't met are loaded as
token-position rows (position, token, next token), and one recursive query joins them with the
merge table, step by step until no pair merges.  In each step a word's leftmost pair of minimum
rank is contracted, and with it every pair whose contraction no pair of a lower rank can come
before: what it might lose a side to, or grow into, is read from the vocabulary (see BESIDE).
Words are cut where nothing merges, before and after the first steps, and equal pieces are contracted once.
So steps are few for words of any length, and the ids are those of one contraction at a time.
Decoding joins token rows with the vocabulary and puts the bytes together by an ordered aggregate.

Every document is handled where it is read: nothing is shuffled, and a lost executor costs its
tasks alone.  What workers remember (words and their ids) is bounded in bytes and only saves
work; texts are handled about CHUNK bytes at a time, long ones in parts cut before white space.

Defined results: a null or empty text has no ids; repeated rows are encoded one by one; null
doc_ids pass through; other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from . import common
from .common import BYTES, Lexicon

#: Unicode white space; Python's own class has four control characters more.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SEGMENT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: White space beside a space, where the pieces between single spaces are not the segments.
ODD = re.sub(r"\\u(....)", r"\\x{\1}", f"[{SPACE}] | [{SPACE}]")  # for Arrow
CUT = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")
SHIFT = 1 << 20  # ids are below this
CHUNK = 8 << 20  # bytes of text at a time
ROWS = 1 << 19  # token rows of one recursion, about
FIRST_STEPS, MORE_STEPS = 2, 2  # in which strict pairs alone are contracted, on parts of words and on what they leave
MARKS = ".,;:!?*%&$#"

#: What the vocabulary says about two tokens side by side.  A pair that no token has in it never
#: merges, nor does anything across it.  m: the token that both make.  onward, back: the least
#: token (its rank) that begins or ends with both.  solid: no token that m is a side of is of a lower rank than m.
#: A pair's code has them in fields of 20 bits, m, onward and back, under the bits of alive and solid.
NONE, ALIVE, SOLID = SHIFT - 1, 2, 3
DEAD = (1 << 60) - 1  # the code of pairs that aren't beside each other in any token
BESIDE = f"""
CREATE TABLE beside AS
WITH cut AS (
  SELECT t AS u, piece, length(piece) + 1 AS n, i, unnest(range(i + 1, length(piece) + 2)) AS j
  FROM (SELECT *, unnest(range(1, length(piece) + 1)) AS i FROM vocabulary)),
part AS (SELECT u, n, i, j, v.t FROM cut JOIN vocabulary v ON v.piece = substr(cut.piece, i, j - i)),
pairs AS (
  SELECT x.t::BIGINT * {SHIFT} + y.t AS pair, min(x.u) FILTER (WHERE x.i = 1 AND y.j = y.n) AS m,
         min(x.u) FILTER (WHERE x.i = 1) AS onward, min(x.u) FILTER (WHERE y.j = y.n) AS back
  FROM part x JOIN part y ON x.u = y.u AND x.j = y.i GROUP BY 1),
loose AS (SELECT DISTINCT side FROM (SELECT unnest([pair // {SHIFT}, pair % {SHIFT}]) AS side, m FROM pairs WHERE m IS NOT NULL) WHERE m < side)
SELECT pair, (({ALIVE} + (m IS NOT NULL AND side IS NULL)::BIGINT) << 60) + (coalesce(m, {NONE})::BIGINT << 40) + (coalesce(onward, {NONE})::BIGINT << 20) + coalesce(back, {NONE}) AS code
FROM pairs LEFT JOIN loose ON side = m
"""

#: rows_in: g (position, over all words), t (token), b (the word's next token, null at its end).
#: strict: the pair (t, b) of rank m is contracted before anything that could take t or b from it:
#: every token that begins with b and what follows, or ends with what precedes and t, is of a higher rank.
#: The first steps contract such pairs alone, which takes one sort; a token between two dead borders is done.
#: Later steps see to the rest.  Tokens between two dead borders are a part; of each the least pair is
#: contracted, strict ones, and of a run of ties after a strict one every second (tie: strict but
#: for the equal pair one place before, as in runs of one letter); parts in which nothing merges are done.
JOINED = f"SELECT a.step, a.g, a.t, coalesce(e.code, {DEAD}) AS code FROM s a LEFT JOIN beside e ON e.pair = a.t::BIGINT * {SHIFT} + a.b WHERE NOT a.done"


def _alive(code: str) -> str:
    return f"({code}) >> 60 >= {ALIVE}"


def _strict(before: str, code: str, after: str) -> str:
    m = f"(({code}) >> 40 & {NONE})"
    return f"(({code}) >> 60 = {SOLID} AND {m} <= (({after}) >> 20 & {NONE}) AND {m} < (({before}) & {NONE}))"


_AT = ["before2", "before", "code", "after", "after2", "after3"]
_STRICT = {i: _strict(*_AT[i + 1 : i + 4]) for i in range(-1, 3)}
_NOW = {i: f"CASE WHEN {_STRICT[i]} THEN (({_AT[i + 2]}) >> 40 & {NONE})::INT ELSE {'t' + str(i or '')} END" for i in range(3)}
BEGIN = f"""
  SELECT step + 1, g, {_NOW[0]}, CASE WHEN {_STRICT[0]} THEN CASE WHEN {_alive('after')} THEN {_NOW[2]} END WHEN {_alive('code')} THEN {_NOW[1]} END,
         NOT ({_alive('code')} OR {_alive('before')})
  FROM (
    SELECT *, lag(code, 2, {DEAD}) OVER o AS before2, lag(code, 1, {DEAD}) OVER o AS before, lead(code, 1, {DEAD}) OVER o AS after,
           lead(code, 2, {DEAD}) OVER o AS after2, lead(code, 3, {DEAD}) OVER o AS after3, lead(t, 1) OVER o AS t1, lead(t, 2) OVER o AS t2
    FROM ({JOINED} AND a.step < {{steps}}) WINDOW o AS (ORDER BY g))
  WHERE NOT {_STRICT[-1]}"""
#: The first steps alone; last: nothing merges across what follows.
FIRST = f"""
WITH RECURSIVE s AS (SELECT 0 AS step, g, t, b, false AS done FROM rows_in UNION ALL ({BEGIN.format(steps=FIRST_STEPS)}))
SELECT g, a.t, pair IS NULL AS last FROM s a LEFT JOIN beside ON pair = a.t::BIGINT * {SHIFT} + b WHERE step = {FIRST_STEPS} OR done ORDER BY g
"""
CONTRACT = f"""
WITH RECURSIVE s AS (
  SELECT 0 AS step, g, t, b, false AS done FROM rows_in
  UNION ALL ({BEGIN.format(steps=MORE_STEPS)}
  UNION ALL
  SELECT {MORE_STEPS}, g, now, CASE WHEN c THEN after_next ELSE next END, least IS NULL FROM (
    SELECT g, now, c, least, lag(c) OVER o AS eaten,
           CASE WHEN alive THEN lead(now) OVER o END AS next,
           CASE WHEN lead(alive) OVER o THEN lead(now, 2) OVER o END AS after_next
    FROM (
      SELECT g, alive, least, c, CASE WHEN c THEN m ELSE t END AS now FROM (
        SELECT g, t, m, alive, least,
               m < {NONE} AND (k = least OR strict OR (tie AND first & 1 = 1 AND (number - first // 2) & 1 = 0)) AS c
        FROM (
          SELECT *, min(k) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS least,
                 max(CASE WHEN NOT tie THEN number * 2 + strict::INT END) OVER (p ROWS UNBOUNDED PRECEDING) AS first
          FROM (
            SELECT g, t, part, number, (code >> 40 & {NONE})::INT AS m, {_alive('code')} AS alive, {_strict('before', 'code', 'after')} AS strict,
                   CASE WHEN m < {NONE} THEN (m::BIGINT << 32) + g END AS k,
                   code >> 60 = {SOLID} AND m <= (after >> 20 & {NONE}) AND m = (before & {NONE}) AND m = (before >> 40 & {NONE}) AS tie
            FROM (
              SELECT *, row_number() OVER o AS number, lag(code, 1, {DEAD}) OVER o AS before, lead(code, 1, {DEAD}) OVER o AS after,
                     sum((NOT {_alive('code')})::INT) OVER (ORDER BY g ROWS UNBOUNDED PRECEDING) - (NOT {_alive('code')})::INT AS part
              FROM ({JOINED} AND a.step >= {MORE_STEPS}) WINDOW o AS (ORDER BY g)))
          WINDOW p AS (PARTITION BY part ORDER BY g)))) WINDOW o AS (ORDER BY g))
  WHERE eaten IS NOT TRUE)
  )
SELECT g, t FROM s WHERE done ORDER BY g
"""
DECODE = "SELECT run, string_agg(piece, '' ORDER BY p) AS piece FROM token_rows JOIN vocabulary USING (t) GROUP BY run ORDER BY run"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def own_spaces(pattern: str) -> str:
    """The pattern with its white space classes written out, inside and outside of brackets."""
    return pattern.replace("[^\\s", f"[^{SPACE}").replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]")


@cache
def letters() -> str:
    """A class of the letters of the first plane, as the pattern's library has them."""
    found = np.array([ord(c) for c in regex.findall("\\p{L}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)])))])
    last = np.append(np.diff(found) > 1, True)
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(found[np.append(True, last[:-1])], found[last], strict=True))


def _connect(threads: int, megabytes: int):
    import duckdb

    return duckdb.connect(config={"threads": threads, "memory_limit": f"{megabytes}MB", "preserve_insertion_order": False})


def _load(sql, **tables: pa.Table) -> None:
    for name, table in tables.items():
        sql.register("loaded", table)
        sql.execute(f"CREATE TABLE {name} AS FROM loaded")
        sql.unregister("loaded")


def _vocabulary(ranks: dict[bytes, int]) -> pa.Table:
    return pa.table({"t": pa.array(ranks.values(), pa.int32()), "piece": [b.decode("latin-1") for b in ranks]})


def beside(ranks: dict[bytes, int]) -> pa.Table:
    """The BESIDE table of a vocabulary, some MB."""
    sql = _connect(4, 700)
    _load(sql, vocabulary=_vocabulary(ranks))
    sql.execute(BESIDE)
    found = sql.sql("FROM beside").to_arrow_table()
    sql.close()
    return found


def rows_of(t: np.ndarray, bounds: np.ndarray) -> pa.Table:
    """rows_in: tokens of sequences, none empty, that begin and end at these bounds."""
    last = np.zeros(len(t), bool)
    last[bounds[1:] - 1] = True
    return pa.table({"g": np.arange(len(t), dtype=np.int32), "t": t, "b": pa.array(np.append(t[1:], 0), pa.int32(), mask=last)})


class Codec:
    """ranks: bytes of each token to its id, which is its rank.  pattern: how texts are split."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pairs: pa.Table | None = None):
        self.ranks, self.split = ranks, regex.compile(own_spaces(pattern))
        # whether the pattern takes a space with letters, and marks after them together
        self.plain = all(self.split.findall(a + b) == [a, b] for a in (" é", " ñandú", " 漢字", " ªº") for b in (MARKS, MARKS[::-1], *MARKS))
        self.sql = _connect(1, 200)
        _load(self.sql, vocabulary=_vocabulary(ranks), beside=beside(ranks) if pairs is None else pairs)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        live = np.zeros(max(ranks.values()) + 1, np.int64)
        live[self.of_byte] = np.arange(256)
        pair = self.sql.sql(f"SELECT pair // {SHIFT} AS a, pair % {SHIFT} AS b FROM beside").to_arrow_table()
        a, b = (pair.column(c).to_numpy() for c in "ab")
        both = np.isin(a, self.of_byte) & np.isin(b, self.of_byte)
        self.dead = np.ones((256, 256), bool)
        self.dead[live[a[both]], live[b[both]]] = False
        self.starts = np.zeros(max(ranks.values()) + 1, bool)
        self.starts[[i for t, i in ranks.items() if t[0] < 128 and not t[:1].isalnum()]] = True
        self.vocabulary = pa.array(ranks, BYTES)
        self.ids = np.fromiter(ranks.values(), "<u4", len(ranks))
        self.tokens, self.units, self.runs = Lexicon(self.contract, 64 << 20), Lexicon(self.learn, 32 << 20), Lexicon(self.spell, 32 << 20)
        self.pieces = Lexicon(self.settle, 24 << 20)

    def query(self, sql: str, **tables: pa.Table) -> pa.Table:
        for name, table in tables.items():
            self.sql.register(name, table)
        try:
            return self.sql.sql(sql).to_arrow_table()
        finally:
            for name in tables:
                self.sql.unregister(name)

    # -- encoding
    def contract(self, words: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """The ids of each word, packed as little-endian 32-bit integers."""
        whole = pc.index_in(words, value_set=self.vocabulary)
        known = whole.is_valid().to_numpy(zero_copy_only=False)
        rest = words.filter(whole.is_null())
        bounds = common.offsets_of(rest)
        raw = np.frombuffer(common.data_of(rest), np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        last = np.append(self.dead[raw[:-1], raw[1:]], True)[: len(raw)]  # nothing merges across these places
        last[bounds[1:][np.diff(bounds) > 0] - 1] = True
        ends = np.append(0, np.flatnonzero(last) + 1)
        coded = common.packed(raw, ends[1:]).dictionary_encode()
        made = self.merged(coded.dictionary).take(coded.indices)
        cuts = common.offsets_of(made)[np.searchsorted(ends, bounds)] // 4
        n, at = np.ones(len(words), np.int64), np.zeros(len(words), np.int64)
        at[known] = whole.drop_null().to_numpy()
        at[~known], n[~known] = len(self.ids) + cuts[:-1], np.diff(cuts)
        return common.packed(common.gather(np.concatenate([self.ids, np.frombuffer(common.data_of(made), "<u4")]), at, n), np.cumsum(n))

    def merged(self, parts: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """The packed ids of distinct parts of words.  What the first steps leave is cut again, and equal pieces are contracted once."""
        out, lo, ends = [pa.array([], BYTES)], 0, common.offsets_of(parts)
        while lo < len(parts):  # bounds what one recursion holds
            hi = min(len(parts), int(np.searchsorted(ends, ends[lo] + ROWS)))
            bounds = ends[lo : hi + 1] - ends[lo]
            got = self.query(FIRST, rows_in=rows_of(self.of_byte[np.frombuffer(common.data_of(parts), np.uint8)[ends[lo] : ends[hi]]], bounds))
            pieces = np.append(0, np.flatnonzero(got.column("last").to_numpy()) + 1)
            coded = common.packed(got.column("t").to_numpy().astype("<u4"), pieces[1:]).dictionary_encode()
            made = self.pieces.of(coded.dictionary).take(coded.indices)
            cuts = common.offsets_of(made)[np.searchsorted(pieces, np.searchsorted(got.column("g").to_numpy(), bounds))] // 4
            out.append(common.packed(np.frombuffer(common.data_of(made), "<u4"), cuts[1:]))
            lo = hi
        return pa.concat_arrays(out)

    def settle(self, pieces: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """The packed ids of distinct sequences of packed tokens."""
        out, lo, ends = [pa.array([], BYTES)], 0, common.offsets_of(pieces) // 4
        while lo < len(pieces):
            hi = min(len(pieces), int(np.searchsorted(ends, ends[lo] + ROWS)))
            bounds = ends[lo : hi + 1] - ends[lo]
            got = self.query(CONTRACT, rows_in=rows_of(np.frombuffer(common.data_of(pieces), "<u4")[ends[lo] : ends[hi]].astype(np.int32), bounds))
            out.append(common.packed(got.column("t").to_numpy().astype("<u4"), np.searchsorted(got.column("g").to_numpy(), bounds[1:])))
            lo = hi
        return pa.concat_arrays(out)

    def looked_up(self, words: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """The packed ids of matches, which may be repeated."""
        coded = words.dictionary_encode()
        return self.tokens.of(coded.dictionary).take(coded.indices)

    def learn(self, units: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """The packed ids of units, cut by the pattern."""
        matches = [[m.encode() for m in self.split.findall(u)] for u in units.cast(pa.large_string()).to_pylist()]
        ids = self.looked_up(pa.array([m for some in matches for m in some], BYTES))
        cuts = common.offsets_of(ids)[np.append(0, np.cumsum([len(m) for m in matches], dtype=np.int64))] // 4
        return common.packed(np.frombuffer(common.data_of(ids), "<u4")[cuts[0] : cuts[-1]], cuts[1:] - cuts[0])

    def ids_of(self, units: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The packed ids of distinct units.  A space with letters, and marks after them, need no pattern."""
        n = len(units)
        if not self.plain:
            return self.units.of(units.cast(BYTES))
        simple = pc.match_substring_regex(units, f"^ [{letters()}]+[{MARKS}]*$")
        plain, other = units.filter(simple), self.units.of(units.filter(pc.invert(simple)).cast(BYTES))
        ends = common.offsets_of(plain)
        # each as two matches, letters and marks, which may be none
        marks = ends[:-1] + pc.binary_length(pc.utf8_rtrim(plain, characters=MARKS)).to_numpy()
        matches = common.packed(np.frombuffer(common.data_of(plain), np.uint8)[ends[0] : ends[-1]], np.stack([marks, ends[1:]], 1).ravel() - ends[0])
        ids = self.looked_up(matches)
        ids = common.packed(np.frombuffer(common.data_of(ids), "<u4"), common.offsets_of(ids)[2::2] // 4)
        simple = simple.to_numpy(zero_copy_only=False)
        order = np.empty(n, np.int64)
        order[simple], order[~simple] = np.arange(len(ids)), len(ids) + np.arange(len(other))
        return pa.concat_arrays([ids, other]).take(pa.array(order))

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and each text's number of them.

        A run of white space and the characters after it are tokenised alike in any
        surroundings: such units are looked up once a chunk, and the ids put together by their codes.
        """
        texts = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()), "")
        ids, sizes = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        for part in common.slices(_parts(texts), CHUNK, lambda p: p[2]):
            whole = [i for i, t, _ in part if t is None]
            got, n = self._encode(texts.slice(whole[0], len(whole)) if len(whole) == len(part) else pa.array([texts[i].as_py() if t is None else t for i, t, _ in part], pa.large_string()))
            ids.append(got)
            np.add.at(sizes, [i for i, *_ in part], n)
        return np.concatenate(ids), sizes

    def _encode(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, ODD)
        pieces = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        bounds, flat = pieces.offsets.to_numpy(), pieces.flatten()
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), coded.dictionary, pa.scalar("", pa.large_string()))
        # the units that don't begin with a space of their own: the first of a text, and those of odd ones
        firsts = bounds[:-1]
        segments = [SEGMENT.findall(t) for t in texts.filter(odd).to_pylist()]
        named = pa.concat_arrays([flat.take(pa.array(firsts)), pa.array([s for some in segments for s in some], pa.large_string())]).dictionary_encode()
        number = named.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(spaced)
        codes[firsts] = number[: len(firsts)]
        odd, lengths = odd.to_numpy(zero_copy_only=False), np.empty(len(texts), np.int64)
        lengths[~odd], lengths[odd] = np.diff(bounds), [len(s) for s in segments]
        mine, merged = np.repeat(odd, lengths), np.empty(lengths.sum(), np.int64)
        merged[mine], merged[~mine] = number[len(firsts) :], codes
        codes = merged
        units = pa.concat_arrays([spaced, named.dictionary]).dictionary_encode()
        codes = units.indices.to_numpy(zero_copy_only=False)[codes]
        packed = self.ids_of(units.dictionary)
        cuts = common.offsets_of(packed) // 4
        n = np.diff(cuts)
        ids = common.gather(np.frombuffer(common.data_of(packed), "<u4").astype(np.int32), cuts[:-1][codes], n[codes])
        upto = np.append(0, np.cumsum(n[codes]))[np.append(0, np.cumsum(lengths))]
        return ids, np.diff(upto)

    # -- decoding
    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of sequences of ids that stand in a row.  Runs that begin with a space or a mark are put together once a chunk."""
        out, ends = [], np.cumsum(sizes)
        for part in common.slices(list(range(len(sizes))), CHUNK // 4, sizes.__getitem__):
            lo = ends[part[0]] - sizes[part[0]]
            out += self._decode(ids[lo : ends[part[-1]]], ends[part] - lo)
        return out

    def _decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        first = self.starts[ids]
        first[::4096] = True  # bounds a run; bytes are put together the same wherever ids are cut
        first[np.append(0, ends)[:-1][np.diff(np.append(0, ends)) > 0]] = True
        at = np.append(np.flatnonzero(first), len(ids))
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((4 * at).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]).dictionary_encode()
        made = self.runs.of(runs.dictionary).take(runs.indices)
        cuts, data = common.offsets_of(made)[np.searchsorted(at, np.append(0, ends))], common.data_of(made)
        return [bytes(data[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]

    def spell(self, runs: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """The bytes of runs of packed ids."""
        out, lo, ends = [pa.array([], BYTES)], 0, common.offsets_of(runs) // 4
        while lo < len(runs):
            hi = min(len(runs), max(lo + 1, int(np.searchsorted(ends, ends[lo] + ROWS))))
            flat = np.frombuffer(common.data_of(runs), "<u4")[ends[lo] : ends[hi]].astype(np.int32)
            lengths = np.diff(ends[lo : hi + 1])
            run = np.repeat(np.arange(hi - lo, dtype=np.int32), lengths)
            p = np.arange(len(flat), dtype=np.int32)
            pieces = self.query(DECODE, token_rows=pa.table({"run": run, "p": p, "t": flat})).column("piece")
            # a character stands for a byte
            raw = "".join(pieces.to_pylist()).encode("latin-1")
            out.append(common.packed(np.frombuffer(raw, np.uint8), np.cumsum(pc.utf8_length(pieces).to_numpy())))
            lo = hi
        return pa.concat_arrays(out)


def _parts(texts: pa.LargeStringArray) -> Iterator[tuple[int, str | None, int]]:
    """Texts by number, as None and their bytes; long ones in parts that are cut before white space that follows other characters."""
    for i, size in enumerate(pc.binary_length(texts).to_pylist()):
        if size <= CHUNK:
            yield i, None, size
            continue
        text, at = texts[i].as_py(), 0
        while len(text) - at > CHUNK and (cut := CUT.search(text, at + CHUNK // 2)):
            yield i, text[at : cut.start()], cut.start() - at
            at = cut.start()
        yield i, text[at:], len(text) - at


_codecs: dict[str, Codec] = {}


def _map(docs: DataFrame, path: str, pattern: str, fn: Callable[[Codec, pa.RecordBatch], list[pa.Array]], schema: str, column: str = "text") -> DataFrame:
    arrow = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}[k]) for n, k in (x.split() for x in schema.split(", "))])
    held, tag = docs.sparkSession.sparkContext.broadcast(_tables(path)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _codecs:  # one for each worker process and query
            _codecs.clear()
            ranks, pairs = held.value
            _codecs[tag] = Codec(ranks, pattern, pairs)
        for some in common.slices(batches, CHUNK, lambda b: b.nbytes):
            batch = pa.Table.from_batches(some).combine_chunks().to_batches()
            for b in batch:
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *fn(_codecs[tag], b)], schema=arrow)
            common.trim()  # what a recursion took: some 250 MB of a worker

    return common.map_batches(docs.select("doc_id", column), run, schema)


_known: dict[str, tuple[dict[bytes, int], pa.Table]] = {}


def _tables(path: str) -> tuple[dict[bytes, int], pa.Table]:
    """The vocabulary and its BESIDE table, made once on the driver (a function of the vocabulary file alone: some MB)."""
    if path not in _known:
        ranks = read_ranks(path)
        _known[path] = ranks, beside(ranks)
    return _known[path]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>) of ``docs(doc_id, text)``."""

    def run(own: Codec, batch: pa.RecordBatch) -> list[pa.Array]:
        ids, sizes = own.encode(batch.column(1))
        return [pa.array(sizes), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids))]

    return _map(docs, path, pattern, run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of ``encoded(doc_id, ids)``; null ids decode to nothing."""

    def run(own: Codec, batch: pa.RecordBatch) -> list[pa.Array]:
        lists = batch.column(1)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return [pa.array(own.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), sizes), pa.binary())]

    return _map(encoded, path, pattern, run, "doc_id long, decoded binary", "ids")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, then decode the ids: their number and the digests of both, without keeping either."""

    def run(own: Codec, batch: pa.RecordBatch) -> list[pa.Array]:
        ids, sizes = own.encode(batch.column(1))
        raw, cuts = memoryview(ids.astype("<u4").tobytes()), np.append(0, 4 * np.cumsum(sizes)).tolist()
        return [
            pa.array(sizes),
            pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)]),
            pa.array([hashlib.sha256(x).hexdigest() for x in own.decode(ids, sizes)]),
        ]

    return _map(docs, path, pattern, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
