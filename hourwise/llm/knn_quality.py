"""Quality classifier by nearest-neighbour voting among labelled latent-semantic vectors.

A document is described by terms: its words (hashed), pairs of neighbouring character classes, how far back each word occurred
before, how long its lines are and how many words it has. Term counts are damped, words are weighted by their rarity, every
group has length one. The latent space are the leading directions of the terms of the labelled sample. The sample's vectors
and labels go to all workers (bounded: `most_rows` rows of `rank` numbers); each document's cosine with every one of them is
computed exactly in blocks, and the `neighbours` nearest vote with their similarity.

Defined results: null and empty texts get the terms of a text of no words; a document without doc_id is never learned from;
of several labels of a doc_id the highest counts, of several rows the one with the smallest hash of its text; without labels every score is 0.5; other columns are not looked at."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructType

from hourwise.llm.common import slices, texts_of, with_columns
from hourwise.llm.toxicity import Hashes, TOKEN, sampled_labels, sampled_rows

WORD_TERMS = 2048
KINDS = np.zeros(256, np.uint8)          # character classes of bytes
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"|", b"<>", b"/\\:@", b"!?;'\"-()", b"#*$%&")):
    KINDS[list(_bytes)] = _k
KINDS[128:] = 12
KINDS[[b for b in range(128) if KINDS[b] == 0 and not chr(b).islower()]] = 13
N_KINDS, GAPS, LINES, LENGTH = 14, 16, 16, 16
GROUPS = (WORD_TERMS, N_KINDS * N_KINDS, GAPS, LINES, LENGTH)
SHARES = (0.6, 1.0, 1.0, 0.6, 0.3)       # length of each group in the whole vector
TERMS = sum(GROUPS)
_HASHES = Hashes()


def term_counts(texts: list[str]) -> np.ndarray:
    """Damped term frequencies, a row per text; groups other than words already have length one."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for row, text in zip(out, texts):
        raw = KINDS[np.frombuffer(text.encode(), np.uint8)].astype(np.intp)
        h = np.fromiter(map(_HASHES.__getitem__, TOKEN.findall(text.lower())), np.int64)
        n = len(h)
        gaps = np.zeros(GAPS)
        if n:
            order = np.argsort(h, kind="stable")
            s = h[order]
            again = s[1:] == s[:-1]
            back = (order[1:] - order[:-1])[again]
            gaps += np.bincount(np.minimum(np.log2(back).astype(int) + 1, GAPS - 1), minlength=GAPS)
            gaps[0] = n - len(back)
        lines = np.array([len(x) for x in text.split("\n")])
        parts = (np.log1p(np.bincount(h % WORD_TERMS, minlength=WORD_TERMS)),
                 np.sqrt(np.bincount(raw[:-1] * N_KINDS + raw[1:], minlength=N_KINDS * N_KINDS)), np.sqrt(gaps),
                 np.sqrt(np.bincount(np.minimum(np.log2(lines + 1).astype(int), LINES - 1), minlength=LINES)),
                 np.bincount([min(int(np.log2(n + 1)), LENGTH - 1)], minlength=LENGTH))
        at = 0
        for k, part in enumerate(parts):
            size = float(np.sqrt((part * part).sum()))
            row[at:at + len(part)] = part if k == 0 or not size else part * (SHARES[k] / size)
            at += len(part)
    return out


def weighted(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    words = counts[:, :WORD_TERMS]
    words *= rarity
    size = np.sqrt((words * words).sum(1, keepdims=True))
    words *= SHARES[0] / np.maximum(size, 1e-12)
    return counts


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None, most_rows: int = 6000, rank: int = 64) -> dict | None:
    """Rarity of the word terms, the latent directions, and vectors and labels of the sample; None without labels."""
    chosen = sampled_labels(labels, label, F.lit(True) if train is None else train, most_rows)
    rows = sampled_rows(docs, chosen)

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id")
        x = term_counts([t or "" for t in part["text"]])
        rarity = np.log((1 + len(x)) / (1 + (x[:, :WORD_TERMS] > 0).sum(0))).astype(np.float32)
        x = weighted(x, rarity)
        _, v = np.linalg.eigh(x.T @ x)
        v = np.ascontiguousarray(v[:, ::-1][:, :rank]).astype(np.float32)
        return pd.DataFrame({"rarity": [rarity.tobytes()], "v": [v.tobytes()], "vectors": [unit(x @ v).tobytes()], "y": [part["y"].to_numpy(np.float32).tobytes()]})
    got = rows.groupBy(F.lit(0).alias("one")).applyInPandas(learn, "rarity binary, v binary, vectors binary, y binary").collect()   # one bounded sample
    if not got:
        return None
    r = got[0]
    v = np.frombuffer(r["v"], np.float32).reshape(TERMS, -1)
    return {"rarity": np.frombuffer(r["rarity"], np.float32), "v": v, "vectors": np.frombuffer(r["vectors"], np.float32).reshape(-1, v.shape[1]), "y": np.frombuffer(r["y"], np.float32)}


def votes(vectors: np.ndarray, labelled: np.ndarray, y: np.ndarray, neighbours: int, power: float) -> np.ndarray:
    """Share of label 1 among the nearest by cosine, weighted by similarity."""
    near = vectors @ labelled.T
    k = min(neighbours, len(y))
    at = np.argpartition(near, len(y) - k, axis=1)[:, len(y) - k:]
    w = np.maximum(np.take_along_axis(near, at, 1), 1e-6).astype(float) ** power
    return (w * y[at]).sum(1) / w.sum(1)


def score(docs: DataFrame, model: dict | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text", neighbours: int = 15, power: float = 12.0) -> DataFrame:
    """`keep` and `score` of every document, whole texts."""
    keep = list(keep)
    source = docs.select(*keep, F.col(text).alias("__text"))
    if model is None:
        return source.select(*keep, F.lit(0.5).alias("score"))
    schema = StructType([source.schema[c] for c in keep]).add("score", DoubleType())
    arrow, shared = to_arrow_schema(schema), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in slices(batches, 256):
            q = unit(weighted(term_counts(texts_of(batch, "__text")), m["rarity"]) @ m["v"])
            yield with_columns(batch, keep, arrow, score=np.clip(votes(q, m["vectors"], m["y"], neighbours, power), 0.0, 1.0))
    return source.mapInArrow(run, schema)
