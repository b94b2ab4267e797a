"""Operator 6: SentencePiece encoding and decoding with a merge-type vocabulary.

A text is escaped (each space as U+2581, one in front) and cut before each run of U+2581 and around
line ends: no piece of the vocabulary crosses such a cut, which is checked when it is loaded, so the
parts encode on their own. In a part, adjacent symbols whose union is a piece stand on an agenda in
order of score, then place; the best pair merges until none is left. Symbols that are no piece fall
back to byte pieces. Distinct parts are encoded once while a worker remembers them, and the new ones
of each Arrow batch are checked against the sentencepiece library.

Defined results: a null text counts as empty (only the begin and end ids); repeated rows give repeated
results; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import column, documents

SPACE = "▁"
#: Parts that a worker remembers, twice over, and the longest of them.
MEMORY, LONGEST = 400_000, 48
OUT = "n_tokens long, ids binary, decoded string"


class Pieces:
    """A vocabulary, its agenda encoder and the parts it has met lately."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        plain = [i for i in range(size) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        pieces = {self.library.id_to_piece(i): i for i in plain}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError("a piece crosses a white space border")
        self.ids = pieces
        self.scores = {p: self.library.get_score(i) for p, i in pieces.items()}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.begin, self.end = (i.to_bytes(4, "little") for i in (self.library.bos_id(), self.library.eos_id()))
        self.parts = re.compile(f"\n+|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.unchecked: list[tuple[str, bytes]] = []

    def merged(self, part: str) -> list[str]:
        """The symbols of a part once the agenda of adjacent pairs is empty."""
        symbols: list[str] = list(part)
        left, right = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        agenda: list[tuple[float, int, int, str]] = []
        score = self.scores.get

        def offer(i: int, j: int) -> None:
            both = symbols[i] + symbols[j]
            if (s := score(both)) is not None:
                heapq.heappush(agenda, (-s, i, j, both))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, both = heapq.heappop(agenda)
            if right[i] != j or symbols[i] + symbols[j] != both or not symbols[j]:
                continue  # one of the two has merged since
            symbols[i], symbols[j] = both, ""
            right[i] = after = right[j]
            if after < len(symbols):
                left[after] = i
                offer(i, after)
            if left[i] >= 0:
                offer(left[i], i)
        return [s for s in symbols if s]

    def part(self, part: str) -> bytes:
        """A part's ids, four bytes each."""
        if (found := self.old.get(part)) is None:
            ids: list[int] = []
            for s in self.merged(part):
                known = self.ids.get(s)
                ids += [known] if known is not None else [self.bytes[b] for b in s.encode()]
            found = b"".join([i.to_bytes(4, "little") for i in ids])
            self.unchecked.append((part, found))
        if len(part) <= LONGEST:
            if len(self.new) >= MEMORY:
                self.old, self.new = self.new, {}
            self.new[part] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text with begin and end, four bytes each."""
        new = self.new.get
        escaped = SPACE + text.replace(" ", SPACE) if text else ""
        return b"".join([self.begin, *[new(p) or self.part(p) for p in self.parts.findall(escaped)], self.end])

    def check(self) -> None:
        """Hold the parts that are new since the last check against the library, each between line ends."""
        todo, self.unchecked = self.unchecked, []
        if not todo:
            return
        line = self.bytes[ord("\n")].to_bytes(4, "little")
        mine = b"".join([self.ids[SPACE].to_bytes(4, "little"), *[x for _, ids in todo for x in (line, ids)]])
        theirs = self.library.encode("\n" + "\n".join([p for p, _ in todo]).replace(SPACE, " "), num_threads=1)
        if mine != array("I", theirs).tobytes():
            raise ValueError("the agenda and the library differ on a part of this batch")

    def decode(self, ids: bytes) -> str:
        return self.library.decode(memoryview(ids).cast("I").tolist())


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encoded(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with the columns n_tokens, ids (four bytes each) and decoded, which replace columns of these names.

    All other columns travel in a struct, so none of them can clash with a private one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [coder.encode(t or "") for t in part.column("text").to_pylist()]
                coder.check()
                columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([coder.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("doc"), *columns], names=["doc", "n_tokens", "ids", "decoded"])

    kept = [column(c) for c in docs.columns if c not in ("n_tokens", "ids", "decoded")]
    carried = docs.select(F.struct(*kept).alias("doc"), column(text_col).cast("string").alias("text"))
    schema = StructType([carried.schema["doc"], *StructType.fromDDL(OUT).fields])
    return carried.mapInArrow(run, schema).select("doc.*", "n_tokens", "ids", "decoded")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    return encoded(docs.select("doc_id", "text"), path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
SQL: dict[str, str] = {}
