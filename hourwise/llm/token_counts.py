"""Token counts: huge documents are encoded in overlapping chunks that are spliced at proven boundaries.

Documents up to `chunk_chars` characters are counted from the library's codes of their pieces. A longer one is encoded by
the library chunk by chunk, each chunk reaching `overlap` characters into the next, with offsets. Two neighbouring chunks
are spliced at a position inside their overlap that is a token border in both encodings and where the pre-tokenizer must cut
whatever stands around it (a space between two characters that are no white space). Left of such a position the tokens do
not depend on what follows, right of it they do not depend on what stands before, so the spliced count is the count of the
whole. If the overlap holds no such position it is doubled, up to the end of the document.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each for itself; an empty table
gives an empty table; columns other than `keep` and the text are not looked at."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StructType

from hourwise.llm.common import slices, texts_of, with_columns
from hourwise.llm.library_codes import MARK, SPACE, byte_pieces, pieces_for

STABLE = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
CHUNK_CHARS = 50_000
OVERLAP = 512


def splice_count(tok, text: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> int:
    """Tokens of one segment without special strings, from overlapping chunks of it."""
    total, start = 0, 0                      # start: a proven border, or the start of the text
    while True:
        core = start + chunk_chars
        wide = overlap
        while True:
            end = min(core + wide, len(text))
            here = tok.encode(text[start:end], add_special_tokens=False)
            if end == len(text):
                return total + len(here.ids)
            ahead = tok.encode(text[core:min(core + wide + chunk_chars, len(text))], add_special_tokens=False)
            # the borders of both encodings in the overlap, as positions in the text
            left = {start + a: k for k, (a, _) in enumerate(here.offsets) if start + a > core}
            right = {core + a for a, _ in ahead.offsets}
            cut = next((m.start() for m in STABLE.finditer(text, core, end)
                        if m.start() in left and m.start() in right), None)
            if cut is not None:
                break
            wide *= 2
        total, start = total + left[cut], cut


def count_texts(texts: list[str], name: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> list[int]:
    codes = pieces_for(name, "count", len)
    counts, plain, spaced, owner = [0] * len(texts), [], [], []
    for at, text in enumerate(texts):
        segments = text.split(MARK)
        counts[at] = len(segments) - 1       # the special string is one token wherever it stands
        for segment in segments:
            if len(segment) > chunk_chars:
                counts[at] += splice_count(codes.tok, segment, chunk_chars, overlap)
            elif segment:
                a, b = byte_pieces(segment)
                plain.append(a)
                spaced.append(b)
                owner.append(at)
    codes.learn(plain, spaced)
    one, two = codes.plain.__getitem__, codes.spaced.__getitem__
    for at, a, b in zip(owner, plain, spaced):
        counts[at] += sum(map(one, a)) + sum(map(two, b))
    return counts


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, text: str = "text",
                 keep: Sequence[str] = ("doc_id",), chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """`keep`, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document."""
    keep = list(keep)
    source = docs.select(*keep, docs[text].alias("__text"))
    schema = StructType([source.schema[c] for c in keep]).add("n_bytes", LongType()).add("n_tokens", LongType()).add("over_limit", BooleanType())
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in slices(batches):
            found = texts_of(batch, "__text")
            n = count_texts(found, tokenizer, chunk_chars, overlap)
            yield with_columns(batch, keep, arrow, n_bytes=[len(t.encode()) for t in found], n_tokens=n, over_limit=[x > limit for x in n])
    return source.mapInArrow(run, schema)

