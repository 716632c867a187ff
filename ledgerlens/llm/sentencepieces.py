"""SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

MODEL = "piece_bpe_32k.model"
MARK = "▁"
CHUNK = re.compile(" +[^ ]*")
LONGEST_KEPT = 64  # longer words are segmented where they stand
MOST_KEPT = 500_000  # words in a task's table; a full table starts anew
BLOCK_CHARS = 2_000_000  # characters of texts that are joined at once, one text at least


@lru_cache(maxsize=2)
def processor(model: str):
    """The library's processor; checks that the vocabulary allows the table.

    Words can be segmented apart if white space is only escaped (identity rules, a mark before the text, no runs
    shortened), no piece has a mark behind another character, and no piece is matched before the merges.
    """
    import sentencepiece
    path = model
    if not os.path.isabs(model):
        import public_tokenizers
        path = public_tokenizers.path(model)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = re.compile(f"[^{MARK}]{MARK}")
    bad = any(crossing.search(sp.id_to_piece(i)) for i in range(sp.get_piece_size()))
    probes = ["a  b ", " a", "ﬁ\t¼", "<s></s>", "a\n\nb", f"a{MARK}b"]
    table = ChunkTable(sp)
    alike = all(got[1:] == (",".join(map(str, ids := sp.encode(p))), sp.decode(ids))
                for p, got in zip(probes, table.join(probes)))
    if bad or not alike:
        raise ValueError("pieces of this vocabulary may cross white space marks")
    return sp


class ChunkTable:
    """Marked word -> its ids, joined by commas; each distinct word is segmented once.

    The words that a block of texts adds are segmented in one call. ``odd`` holds the surface of words that decode to
    anything but themselves.
    """

    def __init__(self, sp):
        self.sp = sp
        self.space = sp.piece_to_id(MARK)
        self.digits = [str(i) for i in range(sp.get_piece_size())]
        self.known, self.odd = {}, {}

    def segment(self, chunks: list[str]) -> None:
        # The library marks the start of what it encodes, as the chunk's own first space does.
        coded = self.sp.encode([c[1:] for c in chunks])
        coded = [ids or [self.space] for ids in coded]
        # A mark before the words keeps the decoder from taking the first space for the one before the text.
        if self.sp.decode([self.space, *chain.from_iterable(coded)]) != "".join(chunks):
            for c, ids in zip(chunks, coded):
                if (surface := self.sp.decode([self.space, *ids])) != c:
                    self.odd[c] = surface
        digit = self.digits.__getitem__
        self.known.update(zip(chunks, [",".join(map(digit, ids)) for ids in coded]))

    def join(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, ids and decoded text of whole texts, joined back by position."""
        marked = [" " + t.replace(MARK, " ") if t else "" for t in texts]
        split = [CHUNK.findall(t) for t in marked]
        words = set().union(*split)
        new = list(words.difference(self.known))
        if len(self.known) + len(new) > MOST_KEPT:
            self.known, self.odd, new = {}, {}, list(words)
        self.segment(new)
        ids, out = self.known.__getitem__, []
        for text, chunks in zip(marked, split):
            decoded = "".join([self.odd.get(c, c) for c in chunks]) if self.odd else text
            joined = ",".join(map(ids, chunks))
            out.append((joined.count(",") + 1 if joined else 0, joined, decoded[1:]))
        for c in new:
            if len(c) > LONGEST_KEPT:
                del self.known[c]
        return out


def blocks(texts: list):
    """Cut a batch into (start, stop, texts) of bounded length; null texts become empty."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= BLOCK_CHARS or i == len(texts) - 1:
            yield start, i + 1, [t or "" for t in texts[start:i + 1]]
            start, chars = i + 1, 0


def encode(docs: DataFrame, model: str = MODEL, with_ids: bool = False) -> DataFrame:
    """Token count and digests of each document's ids and decoded text, exactly as the library gives for whole texts.

    Each task keeps a bounded table of the distinct marked words it met, with their ids and surface, and looks up the
    words of its texts by position; nothing is shuffled, and hot words cost one entry. Null texts count as empty: no
    ids, empty texts. ``with_ids`` adds the ids and the decoded text. Repeated rows give repeated rows.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"

    def run(batches):
        table = ChunkTable(processor(model))
        for batch in batches:
            for start, stop, texts in blocks(batch.column("text").to_pylist()):
                joined = table.join(texts)
                arrays = [batch.column("doc_id").slice(start, stop - start).cast(pa.int64()),
                          pa.array([n for n, _, _ in joined], pa.int64()),
                          pa.array([hashlib.sha256(ids.encode()).hexdigest() for _, ids, _ in joined], pa.string()),
                          pa.array([hashlib.sha256(text.encode()).hexdigest() for _, _, text in joined], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays += [pa.array([[int(i) for i in ids.split(",") if i] for _, ids, _ in joined], pa.list_(pa.int32())),
                               pa.array([text for _, _, text in joined], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """Text of each row's ``ids`` (null counts as none), by the library's decoder."""

    def run(batches):
        sp = processor(model)
        for batch in batches:
            texts = [sp.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())],
                                             ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
