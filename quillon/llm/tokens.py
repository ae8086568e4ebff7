"""Token counts with overlap resynchronisation, and exact encoding in bounded memory.

The tokenizer drops white space and never lets a token cross it, so a text's tokens are those of its words in turn; the
word cache below rests on that alone. A huge text is cut into overlapping chunks, each encoded by itself with offsets.
The chunks' tokens are spliced at a boundary that both have and that is proven stable: beside white space, or between
ASCII characters of which the earlier ends a letter run or is a digit, away from the chunks' cut ends by more than the
longest special token. Where the overlap holds no such boundary it is doubled; at worst one chunk is the rest of the text.

Defined cases: null text counts as empty and has no tokens; repeated rows are counted row by row; other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 300_000
#: Printable ASCII without the apostrophe (contractions need the whole tokenizer) and Latin-1 letters: each such character is
#: its own NFC form, lower-cases alone, and is a letter, a digit or other to the tokenizer's split exactly as SPLIT has it.
SIMPLE = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+").fullmatch
SPLIT = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall
_shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
#: The byte-level map: printable bytes stand for themselves, the others for 256, 257 and so on.
BYTE_MAP = {b: chr(b) for b in _shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _shown)}
_encoders: dict[str, WordEncoder] = {}


class Generations(dict):
    """A cache of bounded size: a full one becomes the old generation, whose entries come back when they are asked for again."""

    def __init__(self, most: int = CACHE_WORDS):
        self.most, self.old = most, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.made(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Pieces(Generations):
    """Ids of a piece of a simple word, from the tokenizer's own model, as bytes of four each: less to keep and to join than numbers."""

    def __init__(self, model):
        super().__init__()
        self.tokenize = model.tokenize

    def made(self, piece: str) -> bytes:
        return packed([t.id for t in self.tokenize(piece if piece.isascii() else "".join(map(BYTE_MAP.__getitem__, piece.encode())))])


class _Words(Generations):
    """Ids of a word, as bytes."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.pieces = tokenizer, _Pieces(tokenizer.model)

    def made(self, word: bytes) -> bytes:
        text = word.decode()
        if SIMPLE(text) and "<|" not in text:
            pieces = SPLIT(text.lower())
            return self.pieces[pieces[0]] if len(pieces) == 1 else b"".join(map(self.pieces.__getitem__, pieces))
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)


class WordEncoder:
    """tokenizers on words, with bounded caches."""

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if os.path.sep in name else public_tokenizers.path(name))
        self.words = _Words(self.tokenizer)

    def ids(self, text: bytes) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.split())), "<u4")

    def count(self, text: bytes) -> int:
        return sum(map(len, map(self.words.__getitem__, text.split()))) // 4

    def starts(self, text: str) -> np.ndarray:
        """Where each token starts, as tokenizers gives its offset in characters."""
        return np.array([a for a, _ in self.tokenizer.encode(text, add_special_tokens=False).offsets], np.int64)


def encoder(name: str = VOCABULARY) -> WordEncoder:
    """One for each worker process. Where words end and which places are stable is known for this vocabulary alone: others are refused."""
    if name.rsplit("/", 1)[-1] != VOCABULARY.rsplit("/", 1)[-1]:
        raise ValueError(f"words are cut as {VOCABULARY} has them; {name} is another vocabulary")
    if name not in _encoders:
        common.alone(_encoders)
        _encoders[name] = WordEncoder(name)
    return _encoders[name]


def stable(text: str, p: int) -> bool:
    """No token of this tokenizer can cross p, whatever surrounds it: see the module's text."""
    a, b = text[p - 1], text[p]
    if a.isspace() and a in " \t\n\r\x0b\x0c" or b in " \t\n\r\x0b\x0c":
        return True
    return a.isascii() and b.isascii() and a.isalnum() and not (a.isalpha() and b.isalpha())


def resync_count(text: str, starts, size: int = 16_384, overlap: int = 512, margin: int = 32) -> tuple[int, int]:
    """Tokens of the text, and how often an overlap had to be widened. starts(chunk) gives the token starts of a chunk."""
    n, total, widened = len(text), 0, 0
    left, kept_from = 0, 0  # the current chunk's start, and the splice before which all is counted
    right = min(n, left + size)
    tokens = starts(text[left:right]) + left
    while right < n:
        grow = overlap
        while True:
            low = max(kept_from, right - grow)
            new_right = min(n, low + max(size, 2 * grow))
            fresh = starts(text[low:new_right]) + low
            head, tail = (low + margin if low else 0), (new_right - margin if new_right < n else n)
            common_starts = np.intersect1d(tokens, fresh)
            common_starts = common_starts[(common_starts >= max(head, kept_from + 1)) & (common_starts < min(right - margin, tail))]
            splice = next((int(p) for p in common_starts[::-1] if stable(text, int(p))), None)
            if splice is not None:
                break
            widened += 1
            if low == kept_from and new_right == n:  # the rest of the text in one chunk is exact by itself
                splice, fresh = kept_from, fresh
                break
            if low == kept_from:  # nothing to widen to the left: take a longer chunk
                right = min(n, right + max(size, grow))
                tokens = starts(text[kept_from:right]) + kept_from
                if right == n:
                    break
            grow *= 2
        if splice is None:
            break
        total += int(((tokens >= kept_from) & (tokens < splice)).sum())
        kept_from, tokens, right = splice, fresh, new_right
    return total + int((tokens >= kept_from).sum()), widened


COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def token_counts(docs: DataFrame, limit: int = 2048, vocabulary: str = VOCABULARY, huge: int = 50_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text. Texts over `huge` bytes are counted chunk by chunk."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for whole in batches:
            for batch in common.slices(whole):
                texts = [t or b"" for t in common.texts(batch)]
                n = [resync_count(t.decode(), chunk_starts(enc))[0] if len(t) > huge else enc.count(t) for t in texts]
                yield common.as_batch({"doc_id": common.ids(batch), "n_bytes": list(map(len, texts)), "n_tokens": n, "over_limit": [x > limit for x in n]}, COUNTS)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def chunk_starts(enc: WordEncoder):
    """Token starts of a chunk from tokenizers' own offsets."""
    return enc.starts
