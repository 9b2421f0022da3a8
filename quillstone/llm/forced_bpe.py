"""BPE encoding by forced boundaries.

A merge never crosses two neighbouring symbols that stand side by side in no token of
the vocabulary. Such pairs mark certain cuts: the fragments between them are encoded
independently of each other and their ids concatenated. Fragments are short and repeat,
so that each is merged once and then looked up.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain
from operator import concat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from quillstone.llm.worker import kept

#: Entries that each of a worker's tables may hold; what is forgotten changes no result.
CACHED = 300_000
#: Characters of words that may be remembered.
REMEMBERED = 64
#: Characters for which Python's lower(), isspace() and categories agree with the library's, and that NFC leaves alone among themselves.
PLAIN = "\t\n\r -~¡-§©®°±¿À-ÖØ-öø-ÿŒœ–—‘’“”…€"
LETTERS = "a-zß-öø-ÿœ"


class ForcedBoundaryEncoder:
    """Encodes and decodes as the library does with the same file, special tokens of a text included."""

    def __init__(self, path: str, cached: int = CACHED):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {k: v for k, v in model["vocab"].items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.token = {v: k for k, v in vocab.items()} | {v: k for k, v in self.special.items()}
        self.inner, self.final = models.BPE(vocab, merges), models.BPE(vocab, merges, end_of_word_suffix=self.suffix)
        # Every symbol pair inside a token, with the suffix as part of the last symbol.
        self.joined = set()
        for t in vocab:
            if t in self.special:
                continue
            stem = t.removesuffix(self.suffix) if self.suffix and t.endswith(self.suffix) and t != self.suffix else t
            symbols = list(stem)
            if stem != t and symbols:
                symbols[-1] += self.suffix
            self.joined.update(zip(symbols, symbols[1:]))
        #: The pairs without the suffix, as strings.
        self.pairs = {a + b for a, b in self.joined if len(b) == 1}
        self.alphabet = _byte_alphabet()
        self.plain = re.compile(f"[{PLAIN}]*")
        # What starts with a letter, a digit or an apostrophe can't start otherwise, so that the commonest kind may come first.
        self.words = re.compile(f"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^ \\t\\n\\r{LETTERS}0-9]+")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cached = cached
        self.fragments: dict[tuple[str, bool], tuple[int, ...]] = {}

    def fragments_of(self, word: str) -> list[str]:
        """The pieces of a word, in the vocabulary's alphabet, between forced boundaries."""
        n = len(word) - 1
        if n < 1 or (word[n - 1], word[n] + self.suffix) in self.joined and self.pairs.issuperset(map(concat, word, word[1:n])):
            return [word]
        pairs = list(zip(word, [*word[1:n], word[n] + self.suffix]))
        cuts = [0, *(i for i, pair in enumerate(pairs, 1) if pair not in self.joined), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def _fragment(self, piece: str, last: bool) -> tuple[int, ...]:
        ids = self.fragments.get((piece, last))
        if ids is None:
            ids = tuple(t.id for t in (self.final if last else self.inner).tokenize(piece))
            if len(piece) <= REMEMBERED:
                if len(self.fragments) >= self.cached:
                    self.fragments.clear()
                self.fragments[piece, last] = ids
        return ids

    def word_ids(self, word: str) -> tuple[int, ...]:
        """The ids of one word of the pre-tokenizer."""
        shown = word.isascii() and word.isprintable() and " " not in word  # these stand for themselves
        pieces = self.fragments_of(word if shown else "".join(self.alphabet[b] for b in word.encode()))
        if len(pieces) == 1:
            return tuple([t.id for t in self.final.tokenize(pieces[0])])
        return tuple(chain.from_iterable(self._fragment(p, i == len(pieces) - 1) for i, p in enumerate(pieces)))

    def _plain_words(self, segment: str) -> list[str]:
        if self.plain.fullmatch(segment):
            return self.words.findall(segment.lower())
        # Any other character: the library's own rules decide what a word is.
        text = self.library.normalizer.normalize_str(segment)
        split = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in split]

    def pieces(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """The words of each stretch between special tokens, and the id of the special token that ends it."""
        parts = self.cut.split(text) if self.cut else [text]
        for i in range(0, len(parts), 2):
            yield self._plain_words(parts[i]) if parts[i] else [], self.special[parts[i + 1]] if i + 1 < len(parts) else None

    def table(self, render: Callable[[tuple[int, ...]], bytes]) -> "_Words":
        """A table from words to what render makes of their ids."""
        return _Words(self, render)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for words, special in self.pieces(text):
            out.extend(chain.from_iterable(map(self.word_ids, words)))
            if special is not None:
                out.append(special)
        return out

    def decode(self, ids: list[int]) -> str:
        """The library's decode without skipping special tokens: its file names no decoder, so that tokens are joined by spaces."""
        return " ".join(self.token[i] for i in ids)


class _Words(dict):
    """Renders a word on its first use; holds a bounded number of them.

    A full table becomes the old one and a new one is begun; words found in the old one
    move over, so that the common words stay.
    """

    def __init__(self, encoder: ForcedBoundaryEncoder, render: Callable):
        super().__init__()
        self.encoder, self.render, self.old = encoder, render, {}

    def __missing__(self, word: str):
        out = self.old.get(word)
        if out is None:
            out = self.render(self.encoder.word_ids(word))
        if len(word) <= REMEMBERED:
            if len(self) >= self.encoder.cached:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


def _byte_alphabet() -> list[str]:
    """The printable character of each byte: itself if it is printable Latin-1, else one from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


@kept
@lru_cache(maxsize=2)
def shared_encoder(path: str) -> ForcedBoundaryEncoder:
    """The encoder of a worker's tasks: read once for each file, its tables go from task to task."""
    return ForcedBoundaryEncoder(path)


@kept
@lru_cache(maxsize=2)
def shared_table(path: str, render: Callable[[ForcedBoundaryEncoder, tuple[int, ...]], object]) -> "_Words":
    """A table of the shared encoder; render has to be a function of a module, which is the same for all tasks."""
    encoder = shared_encoder(path)
    return encoder.table(lambda ids: render(encoder, ids))


@contextmanager
def uncollected() -> Iterator[None]:
    """Without Python's search for cycles: words and ids are many and make none, and it would go through them again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _digested(encoder: ForcedBoundaryEncoder, ids: tuple[int, ...]) -> tuple[bytes, bytes, int]:
    """ids as decimals and the tokens themselves, each followed by a space, and their number."""
    return "".join(f"{i} " for i in ids).encode(), "".join(encoder.token[i] + " " for i in ids).encode(), len(ids)


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Token count and digests of ids and of the decoded text for every row.

    Null texts count as empty and have no tokens. Each row is handled by itself: null
    doc_ids and repeated rows pass through, texts of any length are encoded whole, an empty
    table gives no rows and other columns are ignored. path has to be readable on every
    executor, and name a file of the kind that ForcedBoundaryEncoder knows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = shared_encoder(path), shared_table(path, _digested)
        for batch in batches:
            idents, counts, ids_sha, decoded_sha = batch.column(0), [], [], []
            with uncollected():
                for value in batch.column(1):
                    n, ids, decoded = 0, [], []
                    for words, special in encoder.pieces(value.as_py()):
                        rendered = [table[w] for w in words]
                        ids += [r[0] for r in rendered]
                        decoded += [r[1] for r in rendered]
                        n += sum(r[2] for r in rendered)
                        if special is not None:
                            ids.append(b"%d " % special)
                            decoded.append(encoder.token[special].encode() + b" ")
                            n += 1
                    counts.append(n)
                    ids_sha.append(hashlib.sha256(b"".join(ids)[:-1]).hexdigest())
                    decoded_sha.append(hashlib.sha256(b"".join(decoded)[:-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([idents, pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return whole.mapInArrow(encode, ENCODED)
