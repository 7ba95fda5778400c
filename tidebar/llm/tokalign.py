"""Alignment of two tokenizers over the same bytes, and how often each id of one stands with each id of the other.

Alignment. A text is encoded by both tokenizers; the cumulative byte ends of either side are put into a dictionary
from end to token index. The intersection of the two key sets, sorted, slices both id lists into groups: the
smallest runs of tokens that cover the same bytes. Within a slice those token pairs are linked whose ranges end together.

Reuse. In front of a blank or line feed between two characters that are no white space a token ends on both sides in any context: the byte-level
tokenizer begins a pre-token there and no piece of the other holds a blank behind another character, or a line feed (checked when the vocabulary is
loaded). So a text is cut at these borders, each distinct piece is aligned once per Python worker and kept in a bounded memo, and
the groups of a text are those of its pieces in order. A text with a piece that either tokenizer does not spell byte for byte is
encoded whole, which decides on the joined bytes.

Corpus counts. Documents are handled in blocks of bounded bytes. Links are counted over the corpus by id pair; then each
block fetches the counts of its own distinct pairs through a join and its documents are summed up against them. So no pair table is broadcast and
a frequent pair takes one row per block, not one per occurrence.

Edge cases. Null and empty texts, and texts whose joined bytes differ on either side from blank + text (a U+2581 in the
text, say), have no tokens: zeros and an empty group string. Null ids and repeated rows stay rows of their own and
count for themselves; other columns are ignored; empty tables give empty results. Equal counts: every pair that reaches its B id's highest count is best.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate, chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_small_batches, written

#: A block's texts have about so many code points at most (a longer text is a block of its own); entries of a worker's memo, besides a block's own.
BLOCK_CHARS, MEMO_PIECES = 2_000_000, 400_000
#: A link is kept as the integer a * B_IDS + b.
B_IDS = 32_768
BORDER = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Pieces that are laid end to end and aligned at once.
RUN_PIECES = 4096
NO_TOKENS = (0, 0, 0, "", b"")


def default_tokenizers() -> tuple[str, str]:
    """Paths of the two public vocabularies that the production query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def align(tokens_a: list[bytes], tokens_b: list[bytes]) -> tuple[list[int], list[int], list[int]]:
    """Where the groups of two encodings of the same bytes end: in bytes, in tokens of A and in tokens of B."""
    index_a = dict(zip(accumulate(map(len, tokens_a)), count(1)))
    index_b = dict(zip(accumulate(map(len, tokens_b)), count(1)))
    ends = [e for e in index_a if e in index_b]  # in order, as the ends of A rise
    return ends, list(map(index_a.__getitem__, ends)), list(map(index_b.__getitem__, ends))


def slices(text_a: list[str], text_b: list[str], to_a: list[int], to_b: list[int]) -> list[str]:
    """The groups as text, from the decimal ids of either side."""
    return [
        f"{text_a[i]}|{text_b[k]}" if j - i == 1 == m - k else ",".join(text_a[i:j]) + "|" + ",".join(text_b[k:m])
        for i, j, k, m in zip([0, *to_a], to_a, [0, *to_b], to_b)
    ]


def links_of(ids_a: list[int], ids_b: list[int], to_a: list[int], to_b: list[int]) -> bytes:
    """The links of each slice: its last tokens, as only they end together; ends inside a slice are never shared."""
    last = lambda ids, to: np.array(ids, dtype=np.int32)[np.array(to, dtype=np.int64) - 1]
    return (last(ids_a, to_a) * np.int32(B_IDS) + last(ids_b, to_b)).tobytes()


def plain(p: str) -> bool:
    """A piece that may stand between any others: one blank or line feed in front, no white space behind it and at the end."""
    return len(p) > 1 and p[0] in " \n" and not p[1].isspace() and not p[-1].isspace()


def pieces_of(text: str) -> list[str]:
    """Blank + text, cut at its borders. Where words stand one blank or line feed apart throughout, they are the pieces; a split by the pattern tries every character."""
    words = text.split()
    if " ".join(words) != text.replace("\n", " "):
        return BORDER.split(" " + text)
    if "\n" in text:
        return [w if w[0] == "\n" else " " + w for w in text.replace("\n", " \n").split(" ")]
    return [" " + w for w in words]


class Aligner:
    """Both tokenizers with their token bytes, and the memo of aligned pieces."""

    def __init__(self, path_a: str, path_b: str, memo_pieces: int = MEMO_PIECES):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        self.bytes_a = {i: bytes(map(letters.__getitem__, t)) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if len(pieces) > B_IDS or max(self.bytes_a) >= 2**31 // B_IDS:
            raise ValueError("id pairs of these vocabularies do not fit an integer")
        if any(re.search("[^▁]▁|\n", p) for p in pieces):
            raise ValueError("the second vocabulary joins words or lines")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.text_a, self.text_b = {i: str(i) for i in self.bytes_a}, [str(i) for i in range(len(pieces))]
        self.memo_pieces, self.fresh, self.old = memo_pieces, {}, {}

    def ids_b(self, shown: list[str]) -> list[list[int]]:
        """Ids by B, which puts a blank in front itself; before a line feed that blank is a token of its own and is dropped."""
        found = self.b.encode([s[1:] if s[0] == " " else s for s in shown], num_threads=1)
        return [ids if s[0] == " " else ids[1:] for s, ids in zip(shown, found)]

    def aligned(self, shown: list[str]) -> list[tuple | None]:
        """Per string that begins with a blank or line feed: counts of A, B and groups, the group string and the links; None where the bytes differ."""
        out: list[tuple | None] = []
        bytes_a, bytes_b, text_a, text_b = self.bytes_a, self.bytes_b, self.text_a, self.text_b
        all_a = self.a.encode_batch_fast(shown, add_special_tokens=False)
        all_b = self.ids_b(shown)
        for text, a, ids_b in zip(shown, all_a, all_b):
            ids_a, raw = a.ids, text.encode("utf-8", "surrogatepass")
            tokens_a, tokens_b = [bytes_a[i] for i in ids_a], [bytes_b[i] for i in ids_b]
            if b"".join(tokens_a) != raw or b"".join(tokens_b) != raw:
                out.append(None)
                continue
            ends, to_a, to_b = align(tokens_a, tokens_b)
            shape = ";".join(slices([text_a[i] for i in ids_a], [text_b[i] for i in ids_b], to_a, to_b))
            out.append((len(ids_a), len(ids_b), len(ends), shape, links_of(ids_a, ids_b, to_a, to_b)))
        return out

    def learn(self, pieces: set[str]) -> dict[str, tuple | None]:
        """What is known of all these pieces. Of two generations the older is dropped once the newer is full, so pieces in use stay."""
        if len(self.fresh) > self.memo_pieces // 2:
            self.fresh, self.old = {}, self.fresh
        known, missing = self.fresh, []
        for p in pieces:
            if p not in known:
                if p in self.old:
                    known[p] = self.old[p]
                else:
                    missing.append(p)
        runs, others = [], []
        for p in missing:
            (runs if plain(p) else others).append(p)
        for part, way in ((runs, self.aligned_run), (others, self.aligned)):
            for at in range(0, len(part), RUN_PIECES):
                known.update(zip(part[at : at + RUN_PIECES], way(part[at : at + RUN_PIECES])))
        return known

    def aligned_run(self, pieces: list[str]) -> list[tuple | None]:
        """``aligned`` of plain pieces, laid end to end: a common end lies at every border, so one pair of dictionaries serves them all."""
        text = "".join(pieces)
        all_a = self.a.encode_batch_fast(["".join(pieces[at : at + 64]) for at in range(0, len(pieces), 64)], add_special_tokens=False)
        ids_a = list(chain.from_iterable([e.ids for e in all_a]))
        ids_b = list(chain.from_iterable(self.ids_b(pieces)))
        tokens_a, tokens_b, raw = list(map(self.bytes_a.__getitem__, ids_a)), list(map(self.bytes_b.__getitem__, ids_b)), text.encode("utf-8", "surrogatepass")
        if b"".join(tokens_a) != raw or b"".join(tokens_b) != raw:
            return self.aligned(pieces)
        ends, to_a, to_b = align(tokens_a, tokens_b)
        borders = np.cumsum([len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")) for p in pieces])
        upto = np.searchsorted(ends, borders, side="right")
        if not np.array_equal(np.array(ends)[upto - 1], borders):
            return self.aligned(pieces)
        shapes, links = slices(list(map(self.text_a.__getitem__, ids_a)), list(map(self.text_b.__getitem__, ids_b)), to_a, to_b), links_of(ids_a, ids_b, to_a, to_b)
        n_a, n_b = (np.diff(np.array(to)[upto - 1], prepend=0).tolist() for to in (to_a, to_b))
        cuts = [0, *upto.tolist()]
        return [(x, y, j - i, ";".join(shapes[i:j]), links[4 * i : 4 * j]) for x, y, i, j in zip(n_a, n_b, cuts, cuts[1:])]

    def documents(self, texts: list[str]) -> list[tuple]:
        """The same for whole texts, pieced together from the memo; texts without tokens give zeros."""
        gc.disable()  # strings and tuples of numbers by the million and not one cycle: walking them again and again takes a third of the time
        try:
            return self.pieced(texts)
        finally:
            gc.enable()

    def pieced(self, texts: list[str]) -> list[tuple]:
        split = [pieces_of(t) if t else [] for t in texts]
        known = self.learn(set(chain.from_iterable(split)))
        out = []
        for text, pieces in zip(texts, split):
            parts = list(map(known.__getitem__, pieces))
            if None in parts:
                out.append(self.aligned([" " + text])[0] or NO_TOKENS)
            elif parts:
                n_a, n_b, n_groups, groups, links = zip(*parts)
                out.append((sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), b"".join(links)))
            else:
                out.append(NO_TOKENS)
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The Python worker's aligner: tasks that run in one worker after another share its memo."""
    key = (path_a, path_b)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


ALIGNED = "doc_id long, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>"


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document with its counts, the digest of its groups, its ``links`` (a * 32768 + b, in order) and on demand ``groups`` themselves.

    ``block`` numbers the documents' block by partition and place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, block = aligner(path_a, path_b), TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                end, chars = at + 1, len(texts[at])
                while end < len(texts) and chars + len(texts[end]) <= block_chars:
                    chars += len(texts[end])
                    end += 1
                rows = made.documents(texts[at:end])
                lengths = np.array([len(r[4]) // 4 for r in rows])
                links = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(np.frombuffer(b"".join([r[4] for r in rows]), dtype=np.int32))
                )
                long = lambda v: pa.array(v, type=pa.int64())
                columns = [
                    ids.slice(at, end - at), long([block] * len(rows)), long([r[0] for r in rows]), long([r[1] for r in rows]), long([r[2] for r in rows]), long(lengths),
                    pa.array([sha256(r[3].encode()).hexdigest() if r[3] else "" for r in rows]), links,
                ]
                if keep_groups:
                    columns.append(pa.array([r[3] for r in rows]))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at, block = end, block + 1

    schema = ALIGNED + (", groups string" if keep_groups else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return with_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``link, n`` (its links in the corpus) and ``best`` (no other pair of its B id has more)."""
    counts = aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n")).withColumn("b", F.col("link") % B_IDS)
    counts = written(counts, "links")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("link", "n", (F.col("n") == F.col("most")).alias("best"))


def score_block(docs: pa.Table, weights: pa.Table) -> pa.Table:
    """A block's documents with the sums of their links' counts."""
    link, n, best = (weights.column(c).to_numpy() for c in ("link", "n", "best"))
    order = np.argsort(link)
    link, n, best = link[order], n[order], best[order].astype(np.int64)
    lists = docs.column("links").combine_chunks()
    flat, lengths = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    at = np.searchsorted(link, flat)
    before = lambda v: np.concatenate([[0], np.cumsum(v)]).astype(np.int64)
    ends = before(lengths)
    per_doc = lambda v: pa.array(np.diff(before(v[at])[ends]) if len(flat) else np.zeros(len(lengths), np.int64))
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", per_doc(best)).append_column("count_sum", per_doc(n)).append_column("groups_sha256", docs.column("groups_sha256"))


def crosswalk(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: its alignment, how many of its links are the best of their B id (``n_best``) and the sum of their corpus counts (``count_sum``)."""
    aligned = written(align_documents(docs, path_a, path_b, id_col, text_col, block_chars=block_chars), "aligned")
    own = aligned.select(F.col("block").alias("own_block"), F.explode("links").alias("link")).distinct()
    weights = own.join(pair_counts(aligned), "link").select("own_block", "link", "n", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return aligned.groupBy("block").cogroup(weights.groupBy("own_block")).applyInArrow(score_block, schema)
