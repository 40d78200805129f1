"""Tokenising through the tokenizers library, a pre-token at a time.

The vocabulary lower-cases, drops white space and never joins its pre-tokens. Most texts use only ASCII
and the Latin-1 letters, where its pre-tokens are a plain byte pattern; other texts go word by word. Each
worker remembers the ids of what it has met, so that the library sees a pre-token once, not each time; one
of letters alone goes straight to the library's model, since nothing before the model would change it.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

from mirrorfold.llm.common import Memory, held, texts_of

KNOWN = 96 << 20  # bytes that a worker's remembered pre-tokens take

LETTERS = rb"a-z\xdf-\xf6\xf8-\xff"  # lower case, in Latin-1
PRETOKEN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[" + LETTERS + rb"]+|[0-9]|[^\x20\x09-\x0d0-9" + LETTERS + rb"]+")
PLAIN = bytes(range(128)) + bytes(x for x in range(0xC0, 0x100) if x not in (0xD7, 0xF7))
LETTERS_ONLY = re.compile(rb"[" + LETTERS + rb"]+")
LOWER = bytes(ord(c.lower()) if 0x41 <= i <= 0x5A or 0xC0 <= i <= 0xDE and i != 0xD7 else i for i, c in enumerate(map(chr, range(256))))


def _signs() -> dict[int, str]:
    """The letters that stand for the bytes of a pre-token, as in the library's ByteLevel."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)).difference(shown)))}


SIGNS = _signs()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary: tasks that follow each other share what it remembers."""
    return held(f"tokens {path}", lambda: WordEncoder(path))


class WordEncoder:
    """ids(text) gives little-endian unsigned 32-bit ids of a UTF-8 text."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.memory = Memory(KNOWN)

    def _ask(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 512):
            for e in self.tokenizer.encode_batch_fast(texts[at : at + 512], add_special_tokens=False):
                yield _bytes(e.ids)

    def ids(self, text: bytes | None) -> bytes:
        """Ids of the whole text, worked out piece by piece: white space gives none."""
        return b"".join(map(self._piece, texts_of(text)))

    def _piece(self, text: bytes) -> bytes:
        try:
            plain = text.decode().encode("latin-1")
        except UnicodeEncodeError:
            plain = None
        if plain is None or b"<|" in plain or plain.translate(None, PLAIN):
            return b"".join(self._ask([w.decode() for w in text.split()]))
        parts, memory = PRETOKEN.findall(plain.translate(LOWER)), self.memory.room()
        new = list(set(parts).difference(memory))
        if not new:
            return b"".join(map(memory.__getitem__, parts))
        fresh = self._modelled(new)
        self.memory.keep(fresh.items())
        return b"".join([memory[x] if x in memory else fresh[x] for x in parts])

    def _modelled(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """Ids of plain pre-tokens."""
        out, others, ask = {}, [], self.model.tokenize
        for x in parts:
            if x.isalpha():
                out[x] = _bytes([t.id for t in ask(x.decode())])
            elif LETTERS_ONLY.fullmatch(x):
                out[x] = _bytes([t.id for t in ask(x.decode("latin-1").encode().decode("latin-1").translate(SIGNS))])
            else:
                others.append(x)
        return out | dict(zip(others, self._ask([x.decode("latin-1") for x in others]), strict=True))


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def rows(batches: Iterable, *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values."""
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def arrow(out: Iterable[tuple], schema, size: int = 4096):
    """Tuples gathered into Arrow batches of a schema, a bounded number at a time."""
    import pyarrow as pa

    out = iter(out)
    while some := list(islice(out, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)
