"""Token ids of whole texts by a public word-level BPE vocabulary."""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator

from .common import text_bytes, worker_cache

MARKS = b".,;:!?|"
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
KEEP = 800_000  # chunks whose ids a worker remembers; beyond it starts anew


assert array("I").itemsize == 4 and sys.byteorder == "little", "ids are kept as little-endian 32-bit words"


class ChunkTokenizer:
    """Ids of a text as the joined ids of its chunks between ASCII white space.

    Right for vocabularies whose pre-tokenizer never joins anything across white space and drops it, such as
    ``word_bpe_49k.json``. Texts repeat most chunks, so few are encoded.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ids: dict[bytes, bytes] = {}

    def learn(self, chunks: set[bytes]) -> None:
        """Ids of chunks not seen yet. A word of Latin letters and the marks after it are looked up apart, and a
        plain word in lower case, as the vocabulary has it: so far fewer chunks are encoded."""
        new = chunks.difference(self.ids)  # looks the chunks up; ``-`` would walk through all ids instead
        if len(self.ids) + len(new) > KEEP:
            self.ids, new = {}, chunks
        parts, known = {}, self.ids
        for chunk in new:
            word = chunk.rstrip(MARKS)
            if word.isalpha():
                parts[chunk] = (word.lower(), chunk[len(word):])
            elif len(word) < len(chunk) and LATIN.fullmatch(word.decode("utf-8", "replace")):
                parts[chunk] = (word, chunk[len(word):])
        wanted = list({w for pair in parts.values() for w in pair if w and w not in known}
                      | {c for c in new if c not in parts})
        for start in range(0, len(wanted), 4096):
            part = wanted[start:start + 4096]
            for chunk, coded in zip(part, self.tokenizer.encode_batch_fast(
                    [c.decode("utf-8", "replace") for c in part], add_special_tokens=False)):
                known[chunk] = array("I", coded.ids).tobytes()
        for chunk, (word, marks) in parts.items():
            known[chunk] = known[word] + known[marks] if marks else known[word]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for start in range(0, len(texts), 256):
            split = [text_bytes(t).split() for t in texts[start:start + 256]]
            self.learn(set().union(*split))
            get = self.ids.__getitem__
            for chunks in split:
                yield b"".join(map(get, chunks))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunk_tokenizer(path: str | None) -> ChunkTokenizer:
    """The worker's own tokenizer of that file, kept between tasks."""
    path = str(path or tokenizer_path())
    return worker_cache(("tokens", path), lambda: ChunkTokenizer(path))
