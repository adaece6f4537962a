"""Quality classifier: cumulative-link (ordinal logistic) regression on graded ratings over hashed text.

All grades share one weight per hashed feature; ordered thresholds cut the score into grades.  That gives
an expected grade and the probability of the top grades, by which documents are selected.  Features of a
text are the presence of its words (lower-cased, without punctuation) and of their first four and five
letters, which stand for inflected forms too rare to be seen, and shares, in steps, of the shapes
of its words, of words equal to the word before, of different words and of repeated lines.

The model is fitted on the driver, on a sample of at most about ``max_rows`` rated documents drawn by a
hash of their ids, so the sample is the same in each run; weights have a fixed size (2 ** ``bits``).

Defined results: null and empty texts have the feature of emptiness only and are scored by it; repeated
rows get equal scores; without ratings every score is null and nothing is deselected; ratings that are null
or name no document are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from operator import eq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, refuse_clash
from .words import chunks, texts_of

BITS = 20
_EDGES = b"".join(bytes([c]) for c in range(128) if not chr(c).isalnum())
#: Capital letters stand for A, small ones and bytes beyond ASCII for a, digits for 0.
_KINDS = bytes(65 if chr(c).isupper() else 97 if c >= 128 or chr(c).islower() else 48 if chr(c).isdigit() else c for c in range(128)) + b"a" * 128
_RUNS = re.compile(rb"([Aa0])\1+|(.)\2+", re.S)
#: Words whose feature numbers a worker keeps; beyond that it forgets all, so memory stays bounded.
WORDS_KEPT = 400_000


def _hash(kind: bytes, what: bytes, bits: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(kind + what) >> (64 - bits)


@functools.lru_cache(50_000)
def _shape(kinds: bytes) -> bytes:
    """Runs of letters or of digits as one of them, runs of another character as two, 8 characters at most."""
    return _RUNS.sub(lambda m: m[1] or m[2] * 2, kinds)[:8]


class _Words(dict):
    """Feature numbers and shape by word, computed on first use."""

    def __init__(self, bits: int):
        super().__init__()
        self.bits = bits

    def __missing__(self, raw: bytes) -> tuple[tuple[int, ...], bytes]:
        plain = raw.strip(_EDGES)
        if plain.isascii():
            plain = plain.lower()
            starts = (plain[:4], plain[:5]) if len(plain) > 5 else ()
        else:
            word = plain.decode().lower()
            plain, starts = word.encode(), (word[:4].encode(), word[:5].encode()) if len(word) > 5 else ()
        own = (_hash(b"w", plain, self.bits),) if plain else ()
        if starts:
            own += _hash(b"4", starts[0], self.bits), _hash(b"5", starts[1], self.bits)
        if len(self) >= WORDS_KEPT:
            self.clear()
        got = self[raw] = own, _shape(raw.translate(_KINDS))
        return got


@functools.cache
def _words(bits: int) -> _Words:
    return _Words(bits)


def _step(part: int, whole: int) -> bytes:
    """A share in steps that are finer near 0."""
    return b"%d" % int(round(4 * (1 + 100 * part / whole) ** 0.5))


def features(text: bytes, bits: int = BITS):
    """Distinct feature numbers of a text."""
    import numpy as np

    words = text.split()
    n = len(words)
    if not n:
        return np.array([_hash(b"e", b"", bits)], np.int32)
    counts = Counter(words)
    known = list(map(_words(bits).__getitem__, counts))
    out = set(chain.from_iterable([own for own, _ in known]))
    shapes: dict[bytes, int] = {}
    for (_, shape), c in zip(known, counts.values(), strict=True):
        shapes[shape] = shapes.get(shape, 0) + c
    for shape, c in shapes.items():
        if 20 * c >= n:
            out.add(_hash(b"s" + shape + b"\0", _step(c, n), bits))
    same = sum(map(eq, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x]
    out.add(_hash(b"p", _step(same, n), bits))
    out.add(_hash(b"d", b"%d" % (10 * len(counts) // n) if n >= 20 else b"-", bits))
    out.add(_hash(b"l", _step(len(lines) - len(set(lines)), max(1, len(lines))), bits))
    return np.fromiter(out, np.int32, len(out))


@dataclass
class OrdinalModel:
    """weights: one per feature; cuts: ordered thresholds, one less than there are grades."""

    weights: object
    cuts: object
    bits: int = BITS

    def probabilities(self, scores):
        """P(grade >= j) for j from 1."""
        import numpy as np

        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - np.asarray(scores)[:, None], -60, 60)))


def _likelihood(w, cuts, col, of, y, l2: float):
    """Mean negative log-likelihood with its penalty, and its slopes by weight and by threshold."""
    import numpy as np

    n = len(y)
    f = np.bincount(of, w[col], n)
    odds = np.hstack([np.full((n, 1), -60.0), cuts[None, :] - f[:, None], np.full((n, 1), 60.0)])
    below = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
    hi, lo = below[np.arange(n), y + 1], below[np.arange(n), y]
    p = np.maximum(hi - lo, 1e-9)
    d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
    slope = np.bincount(col, (d_hi - d_lo)[of], len(w)) / n + l2 * w
    slope_cuts = np.array([(np.where(y == j + 1, d_lo, 0) - np.where(y == j, d_hi, 0)).mean() for j in range(len(cuts))])
    return -np.log(p).mean() + l2 / 2 * (w @ w), np.concatenate([slope, slope_cuts])


def _descend(value, x, *, rounds: int, small: float, memory: int = 10):
    """Least value of a convex function by L-BFGS; ``value`` gives (value, slopes), or infinity where it isn't defined."""
    import numpy as np

    now, slope = value(x)
    past: list[tuple] = []
    for _ in range(rounds):
        move, undo = -slope, []
        for s, g, r in reversed(past):
            undo.append(r * (s @ move))
            move = move - undo[-1] * g
        if past:
            s, g, r = past[-1]
            move = move / (r * (g @ g))
        for (s, g, r), a in zip(past, reversed(undo), strict=True):
            move = move + s * (a - r * (g @ move))
        fall, size = slope @ move, 1.0 if past else 1 / max(1.0, np.abs(slope).sum())
        for _ in range(30):
            then, slope_then = value(x + size * move)
            if then <= now + 1e-4 * size * fall:
                break
            size /= 2
        else:
            break
        s, g = size * move, slope_then - slope
        if s @ g > 1e-12:
            past = [*past, (s, g, 1 / (s @ g))][-memory:]
        done = now - then <= small * max(1.0, abs(now))
        x, now, slope = x + s, then, slope_then
        if done:
            break
    return x


def fit_ordinal(rows: list, grades, n_grades: int, *, bits: int = BITS, rounds: int = 300, small: float = 1e-5, l2: float = 1e-3, least_share: float = 0.002) -> OrdinalModel:
    """Greatest penalised likelihood of the cumulative-link model, over all rows, up to steps that gain less than ``small``.

    Features of less than ``least_share`` of the rows get no weight: they only tell single rows apart."""
    import numpy as np

    y = np.asarray(grades)
    n = len(y)
    flat, of = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
    often = np.bincount(flat, minlength=1 << bits)[flat] >= max(2, least_share * n)
    flat, of = flat[often], of[often]
    used, col = np.unique(flat, return_inverse=True)
    share = np.clip([(y <= j).mean() for j in range(n_grades - 1)], 1e-3, 1 - 1e-3)
    start = np.concatenate([np.zeros(len(used)), np.maximum.accumulate(np.log(share / (1 - share))) + 1e-3 * np.arange(n_grades - 1)])

    def value(x):
        w, cuts = x[: len(used)], x[len(used) :]
        if (np.diff(cuts) <= 0).any():
            return np.inf, None
        return _likelihood(w, cuts, col, of, y, l2)

    best = _descend(value, start, rounds=rounds, small=small)
    weights = np.zeros(1 << bits, np.float32)
    weights[used] = best[: len(used)]
    return OrdinalModel(weights, best[len(used) :], bits)


def rated_sample(docs: DataFrame, ratings: DataFrame, *, max_rows: int, id_col: str, text_col: str, grade_col: str, bits: int = BITS) -> DataFrame:
    """(doc_id, grade, feats) for about ``max_rows`` rated documents at most, drawn by a hash of their ids."""
    ratings = ratings.select(ratings[id_col].alias("__id"), ratings[grade_col].cast("int").alias("grade")).dropna()
    n = ratings.count()
    steps = 1 << 20
    drawn = ratings.filter(F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(steps)) < max(1, int(steps * min(1.0, max_rows / max(n, 1)))))
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("__text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("__id")).select("doc_id", "grade", "__text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade"), pa.array([features(t, bits) for t in texts_of(part)], pa.list_(pa.int32()))], names=["doc_id", "grade", "feats"])

    return map_arrow(src, run, f"doc_id {dict(src.dtypes)['doc_id']}, grade int, feats array<int>")


def train(docs: DataFrame, ratings: DataFrame, *, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", bits: int = BITS) -> OrdinalModel | None:
    """A model of grades 0, 1, ... up to the greatest of all ratings, drawn or not; None if no document is rated."""
    import numpy as np

    got = rated_sample(docs, ratings, max_rows=max_rows, id_col=id_col, text_col=text_col, grade_col=grade_col, bits=bits).drop("doc_id").toArrow()
    if not got.num_rows:
        return None
    greatest = ratings.agg(F.max(ratings[grade_col].cast("int"))).first()[0]
    grades = got["grade"].to_numpy()
    rows = got["feats"].combine_chunks()
    flat, ends = rows.values.to_numpy(), rows.offsets.to_numpy()
    by = np.lexsort((np.diff(ends), grades))  # rows come in any order
    return fit_ordinal([flat[ends[i] : ends[i + 1]] for i in by], grades[by], max(2, greatest + 1), bits=bits)


def score_documents(docs: DataFrame, model: OrdinalModel | None, *, least_probability: float = 0.6, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns in ``keep``, then expected_grade, p_top (of the top grade) and selected; no shuffle."""
    refuse_clash(keep, ("expected_grade", "p_top", "selected"))
    src = docs.select(*[docs[c] for c in keep], docs[text_col].alias("__text"))
    if model is None:
        return src.drop("__text").select("*", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("p_top"), F.lit(True).alias("selected"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "__text")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = sent.value
        for batch in batches:
            for part in chunks(batch):
                p = model.probabilities([float(model.weights[features(t, model.bits)].sum()) for t in texts_of(part)])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(p.sum(1)), pa.array(p[:, -1]), pa.array(np.asarray(p[:, -1] >= least_probability))], names=[*keep, "expected_grade", "p_top", "selected"])

    return map_arrow(src, run, f"{own}, expected_grade double, p_top double, selected boolean")


def grades_from_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 poor, 1 well written but toxic, 2 well written and clean."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))
