"""Token ids of text pieces as the tokenizers library gives them, each distinct piece encoded once per worker.

A text is cut only where the pre-tokenizer of the vocabulary must cut anyway, so the ids of a text are the ids of its pieces
one after the other. The memory of known pieces is bounded: it is emptied when full, or its older half is."""
from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hourwise.llm.common import objects, tokenizer_path

# The code points with the Unicode property White_Space.
SPACE = "\t-\r \x85\xa0  -     　"
UNEVEN = re.compile(f"^[{SPACE}]|[{SPACE}][{SPACE}]|[{SPACE}]$")
COARSE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
MOST_PIECES = 1_000_000
MARK = "<|endoftext|>"
LETTERS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|]?)")
ONE, TWO = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$", r"^([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)$"      # one pre-token, and two: signs but the apostrophe are one


def load(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # one task, one core
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


def byte_pieces(text: str) -> tuple[list[str], list[str]]:
    """Pieces of a text free of the special string, for a byte-level vocabulary: (as they stand, to be read behind one space).

    A pre-token holds a space only in front, and white space in it otherwise only if it holds nothing else. So a space with
    other than white space on both sides always starts a pre-token. Texts with white space in pairs or at an end are cut by
    the coarse form of the pre-tokenizer's own pattern, which differs from it only inside runs without white space."""
    if UNEVEN.search(text):
        return COARSE.findall(text), []
    first, *rest = text.split(" ")
    return [first] if first else [], rest


def byte_letters() -> dict[int, str]:
    """The printable letter that a byte-level vocabulary writes for each byte: itself, or the next unused from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Pieces:
    """`of(ids)` for the ids of each known piece, `plain` as it stands and `spaced` behind one space.

    A piece of letters, and a sign behind them, is one pre-token each in any of the vocabularies and goes straight to the
    library's merges; all others go through the library's whole way, joined by the special string, which it never merges
    with anything."""

    def __init__(self, tok, of, most: int = MOST_PIECES, fold: bool = False):
        self.tok, self.of, self.most, self.fold = tok, of, most, fold
        self.mark = tok.token_to_id(MARK)
        self.letters = byte_letters()
        self.signs: dict[str, list[int]] = {}
        self.plain, self.spaced, self.older = {}, {}, {}

    def learn(self, plain: list[list], spaced: list[list]) -> None:
        """Pieces are texts, or texts in UTF-8. Encode what is not known of these pieces; afterwards all of them are known."""
        for known, lists, lead in ((self.plain, plain, ""), (self.spaced, spaced, " ")):
            if len(known) > self.most:
                known.clear()
            self._add(known, {p for pieces in lists for p in pieces if p not in known}, lead)

    def values(self, plain: list[list]) -> list[list]:
        """What `of` makes of every piece, list by list. Each piece is looked up once; only those not known are met again. When
        half of the memory is full, the other half is forgotten, but for what is asked for again."""
        if len(self.plain) > self.most // 2:
            self.older, self.plain = self.plain, {}
        known, older = self.plain, self.older
        found = [list(map(known.get, pieces)) for pieces in plain]
        missed = {p for pieces, values in zip(plain, found) for p, v in zip(pieces, values) if v is None}
        known.update((p, older[p]) for p in missed if p in older)
        self._add(known, {p for p in missed if p not in known}, "")
        return [[known[p] if v is None else v for p, v in zip(pieces, values)] for pieces, values in zip(plain, found)]

    def _add(self, known: dict, new: set, lead: str) -> None:
        merges, other, whole, signs = self.tok.model.tokenize, [], LETTERS.fullmatch, self.signs
        front = lead and self.letters[32]
        for key in new:
            piece = key if isinstance(key, str) else key.decode()
            if m := whole(piece):
                word, sign = m.groups()
                if self.fold:
                    word = word.lower()
                written = front + (word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))
                ids = [t.id for t in merges(written)]
                if sign:
                    if sign not in signs:
                        signs[sign] = [t.id for t in merges(sign)]
                    ids += signs[sign]
                known[key] = self.of(ids)
            elif MARK in piece:
                known[key] = self.of(self.tok.encode(lead + piece, add_special_tokens=False).ids)
            else:
                other.append((key, piece))
        for at in range(0, len(other), 1024):
            self._whole(known, other[at:at + 1024], lead)

    def _whole(self, known: dict, pieces: list[tuple], lead: str) -> None:
        ids = self.tok.encode_batch_fast([MARK.join([lead + p for _, p in pieces])], add_special_tokens=False)[0].ids
        part, each = [], []
        for i in ids:
            if i == self.mark:
                each.append(part)
                part = []
            else:
                part.append(i)
        each.append(part)
        for (key, _), part in zip(pieces, each, strict=True):
            known[key] = self.of(part)


class ClosedWords(Pieces):
    """Pieces in UTF-8 and their ids as little-endian u32, for a vocabulary that drops white space and marks the last token of every
    pre-token by a suffix. Pieces of letters and signs go to the library's merges many at a time, and the marks tell them apart."""

    def __init__(self, tok, of, most: int = MOST_PIECES, fold: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit
        super().__init__(tok, of, most, fold)
        self.merges = Tokenizer(tok.model)              # of pre-tokens as the vocabulary writes them, with spaces between
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.between = self.letters | {32: " "}
        ends, vocab = tok.model.end_of_word_suffix, tok.get_vocab()
        self.closing = np.zeros(max(vocab.values()) + 1, bool)
        self.closing[[i for t, i in vocab.items() if ends and t.endswith(ends)]] = True

    def _add(self, known: dict, new: set, lead: str) -> None:
        pieces, rest = pa.array(list(new), pa.binary()), set()
        texts = pieces.cast(pa.string())
        alone, signed = (pc.match_substring_regex(texts, f) for f in (ONE, TWO))
        fits = pc.or_(alone, signed)
        keys, tokens = objects(pieces.filter(fits)), 1 + signed.filter(fits).to_numpy(False)
        words = objects(pc.replace_substring_regex(texts.filter(fits), TWO, r"\1 \2"))
        for at in range(0, len(keys), 1024):
            line = " ".join(words[at:at + 1024])
            line = (line.lower() if self.fold else line).encode().decode("latin-1").translate(self.between)
            ids = np.array(self.merges.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            closed, last = 4 * np.flatnonzero(self.closing[ids]) + 4, np.cumsum(tokens[at:at + 1024])
            if len(closed) != last[-1]:
                rest.update(keys[at:at + 1024])
                continue
            ends, written = closed[last - 1].tolist(), ids.tobytes()
            known.update(zip(keys[at:at + 1024], [written[a:b] for a, b in zip([0, *ends], ends)]))
        super()._add(known, rest | set(objects(pieces.filter(pc.invert(fits)))), lead)


_LOADED: dict = {}


def pieces_for(name: str, kind: str, of, fold: bool = False, most: int = MOST_PIECES, form: type[Pieces] = Pieces) -> Pieces:
    """The worker's own memory for a tokenizer file, kept from task to task. `fold`: the vocabulary lower-cases."""
    if (name, kind) not in _LOADED:
        _LOADED[name, kind] = form(load(name), of, most, fold)
    return _LOADED[name, kind]
