"""Token ids of whole texts from the tokenizers library, at memo speed.

A text is cut where no token can reach across: before a lone space for byte-level BPE (whose words carry the space in front
of them), at spaces and line feeds for the word BPE (which drops white space).  Arrow cuts a group of texts, numbers its
distinct chunks and joins their ids again, so that Python sees each distinct chunk of a group once.  Its ids are looked up in
the worker's memo or made by the library.  A chunk that is new is first cut further, where that is exact too: at a line feed,
and before closing marks behind a Latin letter; the memo holds the cuts and not what is put together from them.  Where a cut
might not be exact (a space or line feed beside other white space) the library encodes the text whole.  Tests hold both
ways against each other.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that one Python worker remembers (about 100 MB at most); chunks beyond them are encoded again when they come back.
MEMO_CHUNKS = 300_000
_BESIDE = re.compile(r"\s[ \n]|[ \n]\s")
#: White space other than the space and the line feed.
_ODD = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: Byte-level BPE writes each byte as a character: printable ones as themselves, the others from U+0100 on, in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _SHOWN)}
#: Closing marks: behind a Latin letter, a run of them at a chunk's end is a word of its own.
_MARKS = ".,!?:;*#$%&"
#: Latin letters as the byte-level model is shown them.
_LATIN = {c: "".join(_BYTES.get(b, chr(b)) for b in c.encode()) for c in map(chr, range(0x250))}
#: Bytes that Arrow can count with short offsets.
_SHORT = 1 << 31
_MADE: dict[tuple, "Encoder"] = {}


class _Memo(dict):
    """Chunk -> ids as bytes, where the chunk is ``lead`` and the key; ``plain``: the memo of chunks without a lead."""

    def __init__(self, enc: "Encoder", lead: str, plain: "_Memo | None" = None) -> None:
        self.lead, self.plain, self.bpe, self.library, self.kind, self.limit = lead, self if plain is None else plain, enc.library.model, enc.library, enc.kind, enc.limit
        self.shown, self.drop = lead.translate(_BYTES), enc.mode == "drop"

    def __missing__(self, x: str) -> bytes:
        core = x.rstrip(_MARKS)
        if core and len(core) < len(x) and core[-1] < "\u0250" and core[-1].isalpha() and core[-1] != "\u0130":  # its small form ends in a mark
            return self[core] + self.plain[x[len(core) :]]
        if x.isalpha() and (x.isascii() or max(x) < "\u0250") and (not self.drop or x.lower() == x):
            # one run of Latin letters is one word to the BPE model, which is asked without the steps before it
            ids = array(self.kind, [t.id for t in self.bpe.tokenize(self.shown + (x if x.isascii() else "".join(map(_LATIN.__getitem__, x))))]).tobytes()
        elif self.drop and x.isascii() and x.lower() != x:
            return self[x.lower()]
        elif not self.drop and "\n" in x and len(x) > 1:
            first, *rest = x.split("\n")
            plain = self.plain
            return (self[first] if first or self.lead else b"") + b"".join([plain["\n"] + (plain[y] if y else b"") for y in rest])
        else:
            ids = array(self.kind, self.library.encode(self.lead + x, None, False, False).ids).tobytes()
        if len(self) < self.limit:
            self[x] = ids
        return ids


class Encoder:
    """``mode``: "lead" for byte-level BPE, "drop" for BPE that drops white space.  ``dtype`` holds an id, little-endian."""

    def __init__(self, path: str, mode: str, dtype: str = "<u4", memo_chunks: int = MEMO_CHUNKS) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library, self.mode, self.limit = Tokenizer.from_file(path), mode, memo_chunks
        self.kind = "I" if np.dtype(dtype).itemsize == 4 else "H"
        self.plain = _Memo(self, "")
        self.spaced = _Memo(self, " ", self.plain)

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids as the library gives them for each text at once."""
        return [array(self.kind, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, cut = [b""] * len(texts), []
        for k, t in enumerate(texts):
            if not t:
                continue
            if self.mode == "drop":
                cut.append((k, t.replace("\n", " ")))
            elif "  " in t or " \n" in t or "\n " in t or "\n\n" in t or (any(c in t for c in _ODD) and _BESIDE.search(t)):
                out[k] = self.whole([t])[0]
            else:
                cut.append((k, t))
        if cut:
            for (k, _), ids in zip(cut, self._joined([t for _, t in cut]), strict=True):
                out[k] = ids
            pa.default_memory_pool().release_unused()  # a worker keeps no more than its memo from group to group
        return out

    def _joined(self, texts: list[str]):
        """Ids of texts that may be cut at each space."""
        small = 16 * sum(map(len, texts)) < _SHORT  # no character has more than four ids of four bytes
        parts = pc.split_pattern(pa.array(texts, pa.string() if small else pa.large_string()), " ")
        first, numbered = parts.offsets.to_numpy(), parts.values.dictionary_encode()
        del parts
        chunks, number = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy()
        if self.mode == "drop":
            ids = [self.plain[x] for x in chunks]
        else:  # a text's first chunk has no space in front
            number = number.copy()
            heads, number[first[:-1]] = np.unique(number[first[:-1]], return_inverse=True)
            number[first[:-1]] += len(chunks)
            inner = np.bincount(number, minlength=len(chunks))
            ids = [self.spaced[x] if n else b"" for x, n in zip(chunks, inner.tolist(), strict=False)]
            ids += [self.plain[chunks[h]] if chunks[h] else b"" for h in heads.tolist()]
        joined = pa.array(ids, pa.binary() if small else pa.large_binary()).take(pa.array(number))
        _, ends, data = joined.buffers()
        at = np.frombuffer(ends, "<i4" if small else "<i8")[first].tolist()
        data = memoryview(data or b"")
        return [bytes(data[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)]


def encoder(path: str, mode: str, dtype: str = "<u4") -> Encoder:
    """The worker's encoder: loaded once per Python process, its memo shared by all its tasks."""
    key = (path, mode, dtype)
    if key not in _MADE:
        _MADE[key] = Encoder(path, mode, dtype)
    return _MADE[key]


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def gathered(batches, most_chars: int = 4 << 20):
    """``(keys, texts)`` of consecutive rows of about ``most_chars`` characters, whatever batches they came in: enough for
    most chunks to come back, and so few that their ids never pile up."""
    keys, texts, size = [], [], 0
    for b in batches:
        for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            keys.append(k)
            texts.append(t)
            size += len(t or "") + 32  # so that rows without a text are bounded too
            if size >= most_chars:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts
