"""Token counts of whole documents, huge ones by overlapping chunks that are spliced.

A text of one chunk is encoded stretch by stretch, from space to space, if the vocabulary proves that
no piece crosses the start of a space run; what was counted before is remembered. A longer one is cut into chunks that overlap; each is encoded
with the offsets of its pieces. In the overlap of two chunks a common boundary is looked for at
which both encodings have a piece end and which is proven stable: no piece of the vocabulary holds
the character before it directly followed by the one after it. Byte-pair merges only ever make
pieces of the vocabulary, so none crosses such a place, whatever the text around it is, and what
stands on either side is encoded as it is in the whole text. The chunks are spliced there. Where an
overlap has no such place, it is widened, in the end to the whole text. The counts are thus
exactly those of the whole text.

Tokens are counted in the task that reads the row; nothing is shuffled. What a task holds is one
Arrow batch and the pieces of one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of a chunk, and of the overlap that is tried first.
CHUNK, OVERLAP = 32768, 512
#: Counts of so many distinct stretches are remembered in a Python worker.
REMEMBERED = 300_000
#: Rows of a batch are encoded this many at a time, so that few texts are held as Python strings.
ROWS = 256


class Stretches(dict):
    """Token counts of stretches: k spaces and what follows to the next space, written with k - 1 spaces."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, stretch: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[stretch] = len(self.encode(stretch))
        return n


class ChunkedCounter:
    """Counts with one sentencepiece BPE model. If its normaliser changes more than spaces, whole texts are given to the library."""

    def __init__(self, model_path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.chunk, self.overlap = chunk, overlap
        self.widened = 0
        ids = range(self.model.get_piece_size())
        plain = [self.model.id_to_piece(i) for i in ids if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        #: Every two characters that stand side by side in a piece.
        self.joined = {p[i : i + 2] for p in plain for i in range(len(p) - 1)}
        # Boundaries are those of the text only if the normaliser writes spaces as U+2581 and leaves all else as it is. The
        # probe holds each assigned character of the first plane, between letters, and its compositions and runs.
        probe = "".join(f"a{chr(c)}" for c in range(1, 0xFFFE) if not 0xD800 <= c < 0xE000 and c != 0x2581) + "  e\u0301\u0323  ﬁ Ａ"
        self.plain = self.model.normalize(probe) == "▁" + probe.replace(" ", "▁")
        #: Whether a space after anything but a space is always a stable boundary.
        self.split_by_spaces = self.plain and not any(pair[1] == "▁" != pair[0] for pair in self.joined)
        self.known = Stretches(self.model.encode)

    def stable(self, before: str, after: str) -> bool:
        """Whether no piece holds these two characters side by side, so that no merge joins them."""
        return (before + after).replace(" ", "▁") not in self.joined

    def begins(self, text: str) -> list[int]:
        """Where the pieces of a text's encoding begin, in characters; in increasing order."""
        return [begin for begin, _ in self.model.encode(text, return_type="offset_mapping")["offsets"]]

    def count(self, text: str) -> int:
        if len(text) > self.chunk + self.overlap and self.plain:
            return self.spliced(text)
        # A literal U+2581 is a space to the vocabulary, but not to split().
        if not self.split_by_spaces or not text or "▁" in text:
            return len(self.model.encode(text))
        stretches, n, spaces = text.split(" "), 0, 0
        if "" not in stretches:
            return sum(map(self.known.__getitem__, stretches))
        for stretch in stretches:  # an empty one is a further space
            if stretch:
                n += self.known[" " * spaces + stretch]
                spaces = 0
            else:
                spaces += 1
        return n + (len(self.model.encode(" " * (spaces - 1))) if spaces > 1 else spaces)

    def splices(self, text: str) -> Iterator[tuple[int, int]]:
        """(end, tokens) of the stretches between the splices, from the first to the last."""
        begin, done = 0, 0  # the chunk begins at begin; all before done is counted
        while True:
            width = self.overlap
            while True:
                stop = min(len(text), done + self.chunk + width)
                left = [begin + b for b in self.begins(text[begin:stop])]
                if stop == len(text):
                    yield len(text), sum(b >= done for b in left)
                    return
                # Of the next chunk, the encoding is needed in the overlap: a splice is a beginning there too.
                start = stop - width
                right = {start + b for b in self.begins(text[start : min(len(text), stop + width)])}
                splice = next((b for b in reversed(left) if max(start, done) < b < stop and b in right and self.stable(text[b - 1], text[b])), None)
                if splice is not None:
                    break
                self.widened += 1
                width *= 2
            yield splice, sum(done <= b < splice for b in left)
            # The next chunk begins at its overlap, so that the splice is not at its start.
            begin, done = start, splice

    def spliced(self, text: str) -> int:
        return sum(n for _, n in self.splices(text))


@lru_cache(maxsize=4)
def counter(model_path: str, chunk: int, overlap: int) -> ChunkedCounter:
    return ChunkedCounter(model_path, chunk, overlap)


def count_tokens(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens), one for each row of docs, repeated ids included.

    n_bytes is the UTF-8 length. A null text counts as empty: no bytes, no tokens. Texts may be of any
    length and any characters. An empty table gives an empty result. Other columns are not carried.
    """
    kind = docs.schema[id_column].dataType

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path, chunk, overlap)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for start in range(0, batch.num_rows, ROWS):
                for text in batch.column(1).slice(start, ROWS).to_pylist():
                    n_bytes.append(len(text.encode()) if text else 0)
                    n_tokens.append(own.count(text) if text else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(id_column, text_column).mapInArrow(of, f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long")
