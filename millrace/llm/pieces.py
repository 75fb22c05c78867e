"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary has a white-space marker after another character, so the segmentation of a text falls apart
at the places where a run of markers begins: chunks are 'markers, then other characters'.  Each distinct chunk is
segmented and decoded once by the library; the ids of a text are those of its chunks, joined by position.
The table is kept per task and started anew when it holds ``TABLE_SIZE`` chunks; it needs no shuffle.

Defined cases: null text is empty and has no ids.  A vocabulary with pieces across markers is refused.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from millrace.llm.common import annotate

MARK = "▁"
TABLE_SIZE = 250_000
_CHUNK = re.compile(" +[^ ]*")


class ChunkCoder:
    """Encodes and decodes whole texts with one table entry per distinct chunk."""

    def __init__(self, model: str, table_size: int = TABLE_SIZE) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        vocabulary = (self.library.id_to_piece(i) for i in range(self.library.get_piece_size()))
        if any(MARK in piece.lstrip(MARK) for piece in vocabulary):
            raise ValueError("pieces cross white-space markers: chunks cannot be segmented on their own")
        self.table_size = table_size
        self.ids: dict[str, str] = {}
        self.surface: dict[str, str] = {}  # of chunks that decode to something else than themselves
        self.mark_id = self.library.piece_to_id(MARK)

    def chunks(self, text: str) -> list[str]:
        """The library puts one marker before a text; a literal marker is white space to it."""
        return _CHUNK.findall(f" {text.replace(MARK, ' ')}") if text else []

    def learn(self, chunks: set[str]) -> None:
        """Segment the chunks that the table lacks; the library adds each chunk's first marker itself."""
        new = list(chunks - self.ids.keys())
        if new and len(self.ids) + len(new) > self.table_size:
            self.ids, self.surface = {}, {}
            new = list(chunks)
        coded = self.library.encode([c[1:] for c in new], num_threads=1)
        for chunk, ids in zip(new, coded, strict=True):
            ids = ids or [self.mark_id]  # a lone marker
            self.ids[chunk] = ",".join(map(str, ids))
            if (surface := " " + self.library.decode(ids)) != chunk:
                self.surface[chunk] = surface

    def code(self, texts: list[str]) -> list[tuple[str, str]]:
        """(ids joined by commas, decoded text) of every text."""
        split = [self.chunks(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        ids, odd = self.ids.__getitem__, self.surface
        if not odd:
            return [(",".join(map(ids, c)), "".join(c)[1:]) for c in split]
        return [(",".join(map(ids, c)), "".join([odd.get(x, x) for x in c])[1:]) for c in split]


def _coder(model: str, result):
    def make():
        coder = ChunkCoder(model)

        def work(texts: pa.Array) -> list:
            return list(zip(*(result(ids, text) for ids, text in coder.code(texts.to_pylist())), strict=True))

        return work

    return make


def _values(ids: str, text: str):
    return [int(i) for i in ids.split(",")] if ids else [], text


def _digest(ids: str, text: str):
    return (
        ids.count(",") + 1 if ids else 0,
        hashlib.sha256(ids.encode()).hexdigest(),
        hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
    )


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` with token_ids (array) and decoded (text)."""
    return annotate(docs, _coder(model, _values), "token_ids array<int>, decoded string")


def piece_digest(docs: DataFrame, model: str) -> DataFrame:
    return annotate(docs.select("doc_id", "text"), _coder(model, _digest), "n_tokens long, ids_sha256 string, decoded_sha256 string").drop("text")
