"""Pre-tokens of byte-level BPE vocabularies, with results remembered by stretch of text.

No pre-token reaches past a single space between two characters that are no white space (the
space opens the next pre-token). Texts are therefore cut before such spaces, and a stretch
that was seen before is not matched again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa

#: A worker forgets what it remembers beyond this many stretches; results do not depend on it.
REMEMBERED = 800_000
#: Longer stretches are not remembered.
LONGEST = 64
#: Characters of text handled at a time; a longer text is handled alone.
CHUNK_CHARS = 8 << 20

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than blanks and line ends, and the mark used for cutting.
_RARE = re.compile(r"[^\S \n]|\0")


def stretches(text: str) -> list[str]:
    """The text, cut before every single space between characters that are no white space."""
    if not text:
        return []
    ends = text[0].isspace() or text[-1].isspace()
    if ends or "  " in text or "\n " in text or " \n" in text or _RARE.search(text):
        first, *later = _CUT.split(text)
        return [first, *(" " + x for x in later)]
    return text.replace(" ", "\0 ").split("\0")


class Memory:
    """Values of stretches; ``values`` computes those of a list of new ones, whatever is around."""

    def __init__(self, values: Callable[[list[str]], list]):
        self.values, self.known = values, {}

    def of(self, texts: list[str]) -> Iterator[list]:
        """For every text the values of its stretches, in order."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut = [stretches(t) for t in texts]
        new = list(set().union(*cut).difference(self.known))
        if new:
            self.known.update(zip(new, self.values(new)))
        for parts in cut:
            yield list(map(self.known.__getitem__, parts))
        for k in new:
            if len(k) > LONGEST:
                del self.known[k]


def chunked(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Pieces of the batches whose texts (in column ``text``, null: empty) fit a chunk."""
    for batch in batches:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        start, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > CHUNK_CHARS:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]
