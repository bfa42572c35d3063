"""Quality rules by repetition coverage: characters inside repeated word n-grams of several lengths and inside repeated lines.

Words and lines get rolling 64-bit hashes in numpy: a random value per byte value is weighted with powers of an odd number
and summed up once per text, so the hash of any stretch is a difference of two sums times an inverse power. Hashes of
n-grams roll over the word hashes in the same way. A document's hashes are compared only with each other.

Defined results: null and empty texts have no words and fail the base rules; repeated rows are judged each for itself; an
empty table gives an empty table; columns other than `keep` and the text are not looked at. Texts are judged whole."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

from hourwise.llm.common import slices, texts_of, with_columns

# Largest share of a text's characters inside repeated n-grams of each length, and inside repeated lines, as
# published for web text.
LIMITS = {5: 0.15, 7: 0.13, 10: 0.10}
LINE_LIMIT = 0.30
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
ODD, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2 ** 64)
VALUES = np.random.default_rng(7).integers(1, 2 ** 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """base^0 .. base^(count-1) modulo 2^64, kept for texts of common length."""
    held = _POWERS.get(base)
    if held is None or len(held) < count:
        held = np.full(max(count, 1 << 17), base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if len(held) <= 1 << 20:
            _POWERS[base] = held
    return held[:count]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def stretch_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each pair; equal stretches have equal hashes."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(ODD, len(values)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(INVERSE, len(values) + 1)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def repeats(h: np.ndarray) -> np.ndarray:
    """Whether a value occurs twice or more."""
    _, back, n = np.unique(h, return_inverse=True, return_counts=True)
    return n[back] > 1


def covered(repeated: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside any of the n-word windows that are marked."""
    edge = np.zeros(words + 1, np.int32)
    at = np.flatnonzero(repeated)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str, lengths: Sequence[int]) -> tuple[list[int], list[float], float]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), the share of word characters inside repeated n-grams
    of each length, and the share inside lines equal to an earlier one."""
    raw = np.frombuffer(text.encode(), np.uint8)
    blank = SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    if not n:
        return [0, 0, int(SYMBOLS[raw].sum()), 0, 0], [0.0] * len(lengths), 0.0
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    size = chars[ends] - chars[starts]
    total = int(size.sum())
    values = VALUES[raw]
    words = stretch_hashes(values, starts, ends)

    breaks = np.flatnonzero(raw == 10)
    a, b = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(raw)]])
    first_word, past_word = np.searchsorted(starts, a), np.searchsorted(starts, b)
    full = past_word > first_word
    lines = stretch_hashes(values, a[full], b[full])
    _, first = np.unique(lines, return_index=True)
    later = np.ones(len(lines), bool)
    later[first] = False
    before = np.concatenate([[0], np.cumsum(size)])
    in_lines = int((before[past_word[full]] - before[first_word[full]])[later].sum())

    shares, triple = [], 0
    for k in (3, *lengths):
        if n < k:
            shares.append(0.0)
            continue
        at = np.arange(n - k + 1)
        inside = covered(repeats(stretch_hashes(words, at, at + k)), k, n)
        if k == 3 and not shares:
            triple = int(inside.sum())
        shares.append(float(size[inside].sum()) / total)
    return [n, total, int(SYMBOLS[raw].sum()), int(later.sum()), triple], shares[1:], in_lines / total


def judge(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), limits: dict[int, float] | None = None,
          line_limit: float = LINE_LIMIT) -> DataFrame:
    """`keep`, the base counts, base_failed, the coverage shares (gram5_share ..., line_share) and kept.

    base_failed: n_words < 50, or more than half of the words lie in repeated windows of three. kept: not base_failed and no
    share above its limit."""
    keep, limits = list(keep), LIMITS if limits is None else limits
    source = docs.select(*keep, F.col(text).alias("__text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = StructType([source.schema[c] for c in keep])
    for c in counts:
        schema = schema.add(c, LongType())
    schema = schema.add("base_failed", BooleanType())
    for c in (*(f"gram{k}_share" for k in limits), "line_share"):
        schema = schema.add(c, DoubleType())
    schema = schema.add("kept", BooleanType())
    arrow, lengths, most = to_arrow_schema(schema), list(limits), [*limits.values(), line_limit]

    def run(batches):
        for batch in slices(batches):
            found = [measure(t, lengths) for t in texts_of(batch, "__text")]
            columns = {c: [f[0][k] for f in found] for k, c in enumerate(counts)}
            failed = [f[0][0] < 50 or 100 * f[0][4] > 50 * f[0][0] for f in found]
            shares = [[*f[1], f[2]] for f in found]
            columns |= {c: [s[k] for s in shares] for k, c in enumerate((*(f"gram{k}_share" for k in lengths), "line_share"))}
            kept = [not bad and all(s <= m for s, m in zip(share, most)) for bad, share in zip(failed, shares)]
            yield with_columns(batch, keep, arrow, base_failed=failed, kept=kept, **columns)
    return source.mapInArrow(run, schema)
