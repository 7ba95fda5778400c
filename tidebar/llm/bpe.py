"""BPE encoding and decoding with content-defined chunk reuse.

Chunks. A rolling hash over the last ``2 ** WINDOW_BITS`` code points cuts a text where its low
``CUT_BITS`` bits are zero, so equal passages of different documents give equal chunks wherever they
stand. A Python worker keeps the ids of every chunk that it has met, whatever document that was in, so a chunk
is encoded once per worker; a second memo holds the ids of seams and of the pieces that make up new chunks. The memos are
bounded and start afresh when full, which costs time and never changes a result.

Borders and repair. Cuts fall anywhere, also inside words, so tokens near a seam are not those of the
whole text. A border is a blank between two characters that are no white space: the pre-tokenizer
begins a piece there in any context, and the vocabulary's special token has no blank, so text between two
borders has the same tokens alone and in the whole. Of each chunk the ids between its first
and last border are reused. At each seam the left chunk's rest and the right chunk's head are
joined and re-encoded as one window; if a chunk has no border, the window grows over it until there is
one on both sides (at worst it is the whole text). What comes out equals encoding the whole text.

Edge cases. Null texts are encoded as empty: no ids, empty decoded text. Texts of any length are
encoded whole. Repeated rows give repeated rows; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cached_property
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back_memory, with_small_batches

#: Chunks have 2 ** CUT_BITS code points on average; the rolling hash sees 2 ** WINDOW_BITS.
CUT_BITS, WINDOW_BITS = 9, 4
#: Entries of the two memos of a task.
MEMO_PIECES, MEMO_CHUNKS = 700_000, 8_000
BORDER = re.compile(r"(?<=\S)(?= \S)")


def cuts(text: str) -> np.ndarray:
    """Positions at which the rolling hash cuts the text (gear hash, computed for all positions at once)."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h = (code * np.uint32(2654435761)) ^ (code >> np.uint32(7))
    for k in range(WINDOW_BITS):
        step = 1 << k
        shifted = h.copy()
        shifted[step:] += h[:-step] << np.uint32(step) if len(h) > step else 0
        h = shifted
    mixed = (h * np.uint32(2246822519)) >> np.uint32(32 - CUT_BITS)
    return np.flatnonzero(mixed == 0)


def default_tokenizer() -> str:
    """Path of the public vocabulary that the production query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Chunk:
    """What is known of a chunk: the text before its first border, the inside up to its last border with its ids, and what follows.

    ``rest`` is None where the chunk has no border; ``ids`` is None until the ``pieces`` of the inside are encoded.
    """

    __slots__ = ("head", "inside", "rest", "pieces", "ids", "back")

    def __init__(self, chunk: str):
        self.head, *after = BORDER.split(chunk)
        # The text behind the last border is open to the right.
        self.rest = after.pop() if after else None
        self.pieces = tuple(after)
        self.inside = "".join(after)
        self.ids = self.back = None


class Encoder:
    """Encodes and decodes texts through a tokenizers.Tokenizer, each distinct piece once."""

    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES, memo_chunks: int = MEMO_CHUNKS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.memo_pieces, self.memo_chunks = memo_pieces, memo_chunks
        self.pieces: dict[str, str] = {}
        self.odd: dict[str, str] = {}  # pieces that are decoded to another string
        self.chunks: dict[str, Chunk] = {}

    def planned(self, text: str) -> list[str | Chunk]:
        """The text as seams (strings to be encoded as they stand) and the insides of chunks between them."""
        out: list[str | Chunk] = []
        seam, at = "", 0
        for cut in [*cuts(text).tolist(), len(text)]:
            chunk, at = text[at:cut], cut
            if not chunk:
                continue
            found = self.chunks.get(chunk)
            if found is None:
                if len(self.chunks) >= self.memo_chunks:
                    self.chunks.clear()
                found = self.chunks[chunk] = Chunk(chunk)
            # A seam at which the two sides form a border themselves is still one window: it is encoded as it stands.
            seam += found.head
            if found.rest is not None:
                out.append(seam)
                if found.inside:
                    out.append(found)
                seam = found.rest
        if seam:
            out.append(seam)
        return out

    def learn(self, wanted: set[str]) -> None:
        new = list(wanted)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            ids = [e.ids for e in self.tok.encode_batch(part, add_special_tokens=False)]
            for p, i, back in zip(part, ids, self.tok.decode_batch(ids, skip_special_tokens=False)):
                self.pieces[p] = ",".join(map(str, i))
                if back != p:
                    self.odd[p] = back

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Per text its ids (decimal, joined by commas) and its decoded text."""
        for text in texts:
            plan = self.planned(text)
            new = {id(x): x for x in plan if isinstance(x, Chunk) and x.ids is None}.values()
            wanted = {x for x in plan if isinstance(x, str)}.union(*[x.pieces for x in new])
            missing = {p for p in wanted if p not in self.pieces}
            if missing:
                if len(self.pieces) + len(missing) > self.memo_pieces:
                    self.pieces.clear()
                    self.odd.clear()
                    missing = wanted
                self.learn(missing)
            for x in new:
                x.ids = ",".join(map(self.pieces.__getitem__, x.pieces))
                x.back = "".join([self.odd.get(p, p) for p in x.pieces]) if self.odd else x.inside
                x.pieces = ()
            yield (
                ",".join([self.pieces[x] if isinstance(x, str) else x.ids for x in plan]),
                "".join([self.odd.get(x, x) if isinstance(x, str) else x.back for x in plan]),
            )


class WorkerEncoder:
    """An encoder as it travels in a broadcast: a Python worker opens it at its first text, its tasks share the memos, and Spark
    drops it there with the broadcast as soon as the worker turns to other work.

    Spark deals tasks in turn to all idle workers of an executor, which may be more than its cores. Where memory is scarce ``close``
    at the end of a task leaves tokenizers and memos in the busy ones alone, at the price of opening one a task.
    """

    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES):
        self.path, self.memo_pieces = path, memo_pieces

    @cached_property
    def encoder(self) -> Encoder:
        return Encoder(self.path, self.memo_pieces)

    def close(self) -> None:
        self.__dict__.pop("encoder", None)
        give_back_memory()


def encode_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_text: bool = False,
    memo_pieces: int = MEMO_PIECES, keep_memos: bool = True,
) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and on demand ``ids`` (array of int) and ``decoded`` (the text read back).

    ``keep_memos``: a worker keeps tokenizer and memos from one task to the next.
    """

    shared = docs.sparkSession.sparkContext.broadcast(WorkerEncoder(tokenizer_path, memo_pieces))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tok = shared.value.encoder
        try:
            for texts in batches:
                rows = list(tok.encode([t if isinstance(t, str) else "" for t in texts]))
                out = pd.DataFrame({
                    "n_tokens": [ids.count(",") + 1 if ids else 0 for ids, _ in rows],
                    "ids_sha256": [sha256(ids.encode()).hexdigest() for ids, _ in rows],
                    "decoded_sha256": [sha256(back.encode("utf-8", "surrogatepass")).hexdigest() for _, back in rows],
                })
                if keep_ids:
                    out["ids"] = [np.fromstring(ids, dtype=np.int32, sep=",") for ids, _ in rows]
                if keep_text:
                    out["decoded"] = [back for _, back in rows]
                yield out
        finally:
            tok = rows = out = texts = None
            if not keep_memos:
                shared.value.close()

    # The id stays in the JVM, as pandas has no null integers.
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "") + (", decoded string" if keep_text else "")
    encoded = with_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.pandas_udf(run, schema)(text_col).alias("e"))
    return encoded.select("doc_id", "e.*")
