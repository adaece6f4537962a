"""Quality rules on repetition, by suffix arrays over the words of each text.

Texts are handled in blocks of about ``BLOCK_WORDS`` words (a longer text is a block of its own).  The
suffixes of all texts of a block are sorted together by prefix doubling; a suffix ends with its text, so
no repeat crosses texts, and only suffixes that still tie are sorted again.  The ranks of all rounds give
the common prefix of neighbouring suffixes by binary descent.  The intervals of equal common prefixes are
the maximal repeats; the words that they cover and the longest of them decide.

Defined results: a null text has no words and fails the base rules; so does an empty one.  Repeated rows
are judged one by one; an empty table gives an empty result; further columns are ignored or kept by name, and
refused if they have the name of a result.  Very long texts are judged whole: a worker holds about 50 bytes for
each word of a block, and 4 more for each doubling of the longest repeat (300 MB for a text of 2 million words
that is one word again and again).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import map_arrow, refuse_clash
from .words import chunks, forget, texts_of

BLOCK_WORDS, BLOCK_BYTES = 1 << 18, 1 << 21
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class RepetitionRules:
    """``min_repeat`` words make a repeat.  Limits: words covered by repeats, in hundredths of all words,
    and the longest repeat, in words and in hundredths of all words (both must be exceeded to reject)."""

    min_words: int = 10
    window: int = 5
    max_window_percent: int = 20
    min_repeat: int = 4
    max_covered_percent: int = 25
    max_longest_words: int = 40
    max_longest_percent: int = 10


def longest_repeats(codes, starts):
    """For each position, the length of the longest run of codes from it that starts elsewhere in its text.

    codes: integers; starts: the first position of each text, then the number of positions.
    """
    import numpy as np

    n = len(codes)
    longest = np.zeros(n, np.int32)
    if n < 2:
        return longest
    ends = np.repeat(starts[1:], np.diff(starts)).astype(np.int64)
    text = np.repeat(np.arange(len(starts) - 1, dtype=np.int64), np.diff(starts))

    def heads(keys):  # of sorted keys, the first position of each run of equal ones
        new = np.empty(len(keys), bool)
        new[0] = True
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        return new

    key = text * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    new = heads(key[order])
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    sizes = np.diff(np.append(first, n))
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in the order that are still tied
    tied = len(slots)
    small = np.int32 if n < 1 << 31 else np.int64
    levels, h = [rank.astype(small)], 1
    while tied:
        at = order[slots]
        nxt = at + h
        second = np.where(nxt < ends[at], rank[np.minimum(nxt, n - 1)] + 1, 0)
        pair = rank[at] * (n + 1) + second
        by = np.argsort(pair, kind="stable")
        at, pair = at[by], pair[by]
        order[slots] = at
        new = heads(pair)
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(pair)))
        rank[at] = np.repeat(slots[first], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        tied = len(slots)
        levels.append(rank.astype(small))
        h *= 2
    # common prefixes of neighbours that share their first word
    a, b = order[:-1], order[1:]
    near = levels[0][a] == levels[0][b]
    a, b = a[near], b[near]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        ok = (x < ends[a]) & (y < ends[b])
        if not ok.any():
            continue
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        # equal ranks after k rounds mean 2**k equal words, unless the text ends earlier for both, which the order rules out
        ok &= levels[k][x] == levels[k][y]
        common[ok] += 1 << k
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(longest, least: int):
    """Which positions lie in a repeat of at least ``least`` words."""
    import numpy as np

    n = len(longest)
    at = np.flatnonzero(longest >= least)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + longest[at], -1)
    return np.cumsum(step[:n]) > 0


def _sums(flags, starts):
    import numpy as np

    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def _maxima(values, starts):
    import numpy as np

    out = np.zeros(len(starts) - 1, np.int64)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        out[full] = np.maximum.reduceat(values, starts[:-1][full])
    return out


def _blocks(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[list[bytes]]]]:
    """Texts with their words, in blocks of bounded size."""
    some, words, n = [], [], 0
    for t in texts:
        w = t.split()
        if some and n + len(w) > BLOCK_WORDS:
            yield some, words
            some, words, n = [], [], 0
        some.append(t)
        words.append(w)
        n += len(w)
    if some:
        yield some, words


def _measure(texts: list[bytes], words: list[list[bytes]], rules: RepetitionRules) -> dict:
    import numpy as np

    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for ws in words for w in ws), np.int64, sum(map(len, words)))
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    point = np.ones(256, bool)
    point[0x80:0xC0] = False
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    dups = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        dups.append(len(lines) - len(set(lines)))
    longest = longest_repeats(codes, starts)
    n_words = np.diff(starts)
    base = _sums(covered(longest, rules.window), starts)
    failed = (n_words < rules.min_words) | (100 * base > rules.max_window_percent * n_words)
    cover = _sums(covered(longest, rules.min_repeat), starts)
    top = _maxima(longest, starts)
    bad = (100 * cover > rules.max_covered_percent * n_words) | ((top > rules.max_longest_words) & (100 * top > rules.max_longest_percent * n_words))
    return {"n_words": n_words, "word_chars": _sums((point & ~space)[raw], ends), "n_symbols": _sums(symbol[raw], ends), "n_dup_lines": np.array(dups, np.int64), "n_repeat_words": base, "n_covered_words": cover, "longest_repeat": top, "base_failed": failed, "kept": ~(failed | bad)}


MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_covered_words bigint, longest_repeat bigint, base_failed boolean, kept boolean"


def measure_repetition(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), only_kept: bool = False) -> DataFrame:
    """The columns in ``keep``, then the measures and the verdict ``kept``; no shuffle.

    With ``only_kept``, rows that the rules reject are left out and only the columns in ``keep`` returned.
    """
    if not only_kept:
        refuse_clash(keep, tuple(m.split()[0] for m in MEASURES.split(", ")))
    src = docs.select(*[docs[c] for c in keep], docs[text_col].alias("__text"))
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "__text")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        forget("byte_bpe")
        for chunk in (c for batch in batches for c in chunks(batch, most=BLOCK_BYTES)):
            at = 0
            for texts, words in _blocks(texts_of(chunk)):
                got = _measure(texts, words, rules)
                part = chunk.slice(at, len(texts))
                at += len(texts)
                if only_kept:
                    part = part.filter(pa.array(got["kept"]))
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in keep], names=list(keep))
                else:
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(np.asarray(v)) for v in got.values())], names=[*keep, *got])

    return map_arrow(src, run, own if only_kept else f"{own}, {MEASURES}")
