"""Fuzzy similarities on 0-100, from their published definitions.

Vectorised UDFs with a bit-parallel longest common subsequence (an integer a word long holds a
whole row of the table), and ``ratio_native``, the same ratio as a column expression.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.functions import pandas_udf


def struct_of(**kinds: Ty.DataType) -> Ty.StructType:
    """Types as objects: workers import these modules too, and can't parse their names."""
    return Ty.StructType([Ty.StructField(n, k) for n, k in kinds.items()])


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    full = row = (1 << len(b)) - 1
    for c in a:
        u = row & at.get(c, 0)
        row = (row + u | row - u) & full
    return len(b) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs(a, b) / total


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter with a stretch of the longer: as long as it, or shorter at the ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0

    def one_way(short: str, long: str) -> float:
        n, best = len(short), 0.0
        spans = [(0, i) for i in range(1, n)] + [(i, i + n) for i in range(len(long) - n + 1)] + [(i, len(long)) for i in range(len(long) - n + 1, len(long))]
        letters = set(short)
        for lo, hi in spans:
            # a best stretch begins and ends with a letter of the shorter one
            if (long[hi - 1] in letters if lo == 0 else long[lo] in letters) or hi - lo == n:
                best = max(best, ratio(short, long[lo:hi]))
                if best == 100.0:
                    break
        return best

    return max(one_way(a, b), one_way(b, a)) if len(a) == len(b) else one_way(a, b)


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _sets(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_set_ratio(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, left, right = _sets(a, b)
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = ratio(one, two)
    return max(best, ratio(both, one), ratio(both, two)) if both else best


def partial_token_ratio(a: str, b: str) -> float:
    both, left, right = _sets(a, b)
    if both:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(left, right))


def wratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    length = max(len(a), len(b)) / min(len(a), len(b))
    if length < 1.5:
        return max(ratio(a, b), 0.95 * token_sort_ratio(a, b), 0.95 * token_set_ratio(a, b))
    p = 0.9 if length <= 8 else 0.6
    return max(ratio(a, b), p * partial_ratio(a, b), 0.95 * p * partial_token_ratio(a, b))


METRICS = {f.__name__: f for f in (ratio, partial_ratio, token_sort_ratio, token_set_ratio, wratio)}


def metric(name: str):
    """A vectorised UDF of two string columns; null gives null, equal pairs of a batch are scored once."""
    own = METRICS[name]

    @pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple, float | None] = {}
        return pd.Series([known[p] if p in known else known.setdefault(p, None if p[0] is None or p[1] is None else own(*p)) for p in zip(a, b, strict=True)], dtype="float64")

    return score


@pandas_udf(struct_of(**dict.fromkeys(("partial_ratio", "token_sort_ratio", "token_set_ratio", "wratio", "best"), Ty.DoubleType())))
def scores(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """All metrics of a keyword score; best leaves nothing out."""
    known: dict[tuple, tuple] = {}
    out = []
    for p in zip(a, b, strict=True):
        if p not in known:
            four = (0.0,) * 4 if not p[0] or not p[1] else (partial_ratio(*p), token_sort_ratio(*p), token_set_ratio(*p), wratio(*p))
            known[p] = (*four, max(four))
        out.append(known[p])
    return pd.DataFrame(out, columns=["partial_ratio", "token_sort_ratio", "token_set_ratio", "wratio", "best"], dtype="float64")


def partial_many(key: str, pieces: list[tuple[str, str]], floor: np.ndarray) -> np.ndarray:
    """partial_ratio of a key and each longer text; a value that isn't above its floor comes back as the floor.

    pieces: (text, kind); of a ``head`` only the stretches at its begin that are shorter than the
    key count, of a ``tail`` those at its end, of a ``full`` text all.  The key's letters that a
    stretch holds bound its ratio, so only stretches whose bound is above the best so far are compared.
    """
    n, best = len(key), floor.astype(float)
    if not pieces:
        return best
    if n > 63:
        return np.array([max(f, partial_ratio(key, t)) for (t, _), f in zip(pieces, floor, strict=True)])
    pad = next(c for c in map(chr, range(n + 1)) if c not in key) * (n - 1)
    codes = np.frombuffer("".join([x for t, _ in pieces for x in (pad, t)] + [pad, pad, key[:1]]).encode("utf-32-le", "surrogatepass"), np.uint32)
    table = np.zeros(max(int(codes.max()), max(map(ord, key))) + 1, np.uint64)
    for i, c in enumerate(key):
        table[ord(c)] |= np.uint64(1 << i)
    mask = table[codes]
    count = np.append(0, np.cumsum(mask != 0, dtype=np.int32))
    size = np.array([len(t) for t, _ in pieces])
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), size + n - 1)
    at = np.arange(len(owner))
    start = at - (np.cumsum(size + n - 1) - size)[owner]  # of the stretch in its text, before it for heads
    length = np.minimum(start + n, size[owner]) - np.maximum(start, 0)
    bound = 200.0 * (count[at + n] - count[at]) / (n + length)
    kind = np.array([("full", "head", "tail").index(k) for _, k in pieces], np.int8)[owner]
    left = np.flatnonzero((bound > best[owner]) & ((kind == 0) | ((kind == 1) == (start < 0))))
    left = left[np.argsort(-bound[left], kind="stable")]
    take, full = 4096, np.uint64((1 << n) - 1)
    while len(left):
        now, left, take = left[:take], left[take:], take * 2
        row = np.full(len(now), full)
        for i in range(n):
            u = row & mask[now + i]
            row = ((row + u) | (row - u)) & full
        np.maximum.at(best, owner[now], 200.0 * (n - np.bitwise_count(row).astype(float)) / (n + length[now]))
        left = left[bound[left] > best[owner[left]]]
    return best


def corpora(norm: str, parts: list[str]) -> list[str]:
    """What a keyword is looked for in: the text, its segments, two and three neighbours, the text without spaces."""
    found = [norm, *parts, *(" ".join(parts[i : i + w]) for w in (2, 3) for i in range(len(parts) - w + 1)), "".join(norm.split())]
    return [c for c in dict.fromkeys(found) if c]


def keyword_scores(docs: list[tuple[str, list[str]]], key: str, weighted: bool = True) -> np.ndarray:
    """The best of the metrics over each document's corpora; without the weighted ratio where so asked.

    Exact: a metric is left out only where its bound by lengths isn't above the best that is known.
    """
    n, best = len(key), np.zeros(len(docs))
    if not key:
        return best
    found = [corpora(*d) for d in docs]
    if " " not in key and n <= 12:  # a short keyword with spaces between its letters
        best[[i for i, cs in enumerate(found) if any(key in "".join(c.split()) for c in cs)]] = 100.0

    def raise_to(owner: list[int], values: np.ndarray) -> None:
        np.maximum.at(best, np.array(owner, int), values)

    def partials(key: str, pieces: list[tuple[str, str]], owner: list[int], factor: np.ndarray | float = 1.0) -> None:
        raise_to(owner, factor * partial_many(key, pieces, best[np.array(owner, int)] / factor))

    whole = [i for i, (norm, _) in enumerate(docs) if best[i] < 100 and len(norm) > n]
    partials(key, [(docs[i][0], "full") for i in whole], whole)
    pieces, owner = [], []
    for i, cs in enumerate(found):
        norm, at = docs[i][0], 0
        for c in cs if best[i] < 100 else []:
            if len(c) > n and c is not norm:
                where = norm.find(c, at)
                if where >= 0:  # its inner stretches were those of the text
                    pieces += [(c[: n - 1], "head"), (c[1 - n :], "tail")] if n > 1 else []
                    owner += [i, i] if n > 1 else []
                    at = where
                else:
                    at = 0
                    pieces.append((c, "full"))
                    owner.append(i)
    partials(key, pieces, owner)

    def short(i: int, c: str, key: str, factor: float = 1.0) -> None:
        """A text that isn't longer than the key: the key's letters in it bound its ratio with any stretch."""
        most = sum(map(letters.__contains__, c))
        if factor * 200.0 * most / (len(c) + most) > best[i]:
            if (c, key) not in known:
                known[c, key] = partial_ratio(c, key)
            best[i] = max(best[i], factor * known[c, key])

    letters, known = set(key), {}
    for i, cs in enumerate(found):
        for c in cs if best[i] < 100 else []:
            if len(c) <= n:
                short(i, c, key)

    words, ordered = set(key.split()), " ".join(sorted(key.split()))
    unique = " ".join(sorted(words))
    most = lambda a, b: 200.0 * min(a, b) / (a + b)
    late: dict[str, list[tuple[str, int, float]]] = {ordered: [], unique: []}
    for i, cs in enumerate(found):
        for c in cs if best[i] < 100 else []:
            m, own = len(c), set(tokens := c.split())
            shared, ratio_of_lengths = own & words, max(n, m) / min(n, m)
            p = 0.95 * (0.9 if ratio_of_lengths <= 8 else 0.6)
            if most(n, m) > best[i]:
                best[i] = max(best[i], token_sort_ratio(c, key), ratio(c, key) if weighted else 0.0)
            if shared or most(sum(map(len, own)) + len(own) - 1, len(unique)) > best[i]:
                both = len(" ".join(sorted(shared)))
                one = sum(map(len, own)) + len(own) - 1
                bounds = (most(one, len(unique)), 200.0 * both / (both + one), 200.0 * both / (both + len(unique))) if shared and shared != words and shared != own else (100.0,)
                if max(bounds) > best[i]:
                    best[i] = max(best[i], token_set_ratio(c, key))
            if weighted and ratio_of_lengths >= 1.5 and 100.0 * p > best[i]:
                if shared:
                    best[i] = 100.0 * p
                else:
                    for k, t in ((ordered, " ".join(sorted(tokens))), (unique, " ".join(sorted(own)))):
                        if len(t) > len(k):
                            late[k].append((t, i, p))
                        else:
                            short(i, t, k, p)
    for k, todo in late.items():
        todo = [x for x in dict.fromkeys(todo) if 100.0 * x[2] > best[x[1]]]
        partials(k, [(t, "full") for t, _, _ in todo], [i for _, i, _ in todo], np.array([p for _, _, p in todo]))
    return best


@pandas_udf(Ty.DoubleType())
def keyword_score(norm: pd.Series, parts: pd.Series, key: pd.Series, weighted: pd.Series) -> pd.Series:
    """keyword_scores of rows, some MB of text at a time."""
    out, groups = np.zeros(len(norm)), {}
    for i, g in enumerate(zip(key, weighted, strict=True)):
        groups.setdefault(g, []).append(i)
    for (k, w), rows in groups.items():
        part, size = [], 0
        for i in rows:
            part.append(i)
            size += len(norm.iloc[i])
            if size >= 1 << 19 or i == rows[-1]:
                out[part] = keyword_scores([(norm.iloc[j], list(parts.iloc[j])) for j in part], k, bool(w))
                part, size = [], 0
    return pd.Series(out)


def lcs_native(a: Column, b: Column) -> Column:
    """The table's rows as arrays, folded over the characters of a: no Python."""
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    right = chars(b)
    zero = F.array_repeat(F.lit(0), F.size(right) + 1)

    def row(prev: Column, c: Column) -> Column:
        step = lambda acc, j: F.concat(
            acc, F.array(F.when(F.get(right, j) == c, F.get(prev, j) + 1).otherwise(F.greatest(F.get(prev, j + 1), F.element_at(acc, -1))))
        )
        return F.aggregate(F.when(F.size(right) > 0, F.sequence(F.lit(0), F.size(right) - 1)).otherwise(F.array().cast("array<int>")), F.array(F.lit(0)), step)

    return F.element_at(F.aggregate(chars(a), zero, row), -1)


def ratio_native(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(F.lit(200.0) * lcs_native(a, b) / total)
