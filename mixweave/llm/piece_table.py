"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the model crosses a whitespace marker (checked when the model is loaded), a text
falls apart into marked words that the model segments independently of each other. Each batch
collects its distinct marked words, has the library segment those not yet in the task's table, and
joins ids back by position; a word is segmented again in a task only after it was long unused. Ids are decoded through a table of the pieces' bytes. Models without that property are
encoded text by text. Nothing is shuffled.

Defined results: a null text counts as empty; an empty text gives the end id alone; ids and decoded
text equal the library's for any text; an empty table gives an empty table. Other columns are kept;
`ids` and `decoded` replace columns of those names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

MARK = "▁"
#: Entries beyond which a task drops the half of its table that was used longest ago; bounds memory, not results.
TABLE_ENTRIES = 200_000
#: Characters of text that are segmented at once.
BATCH_CHARS = 4 << 20
_CHUNK = re.compile(" +[^ ]*")


class PieceTable:
    """Bytes of each piece; decodes ids as the library does, which itself takes what is unusual."""

    def __init__(self, sp):
        self.sp = sp
        self.bytes: list[bytes | None] = []
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                self.bytes.append(bytes([int(sp.id_to_piece(i)[3:-1], 16)]))
            else:
                self.bytes.append(None if sp.is_unknown(i) else b"" if sp.is_control(i) else sp.id_to_piece(i).replace(MARK, " ").encode())

    def decode(self, ids: list[int]) -> str:
        try:
            text = b"".join([self.bytes[i] for i in ids]).decode()
        except (TypeError, UnicodeDecodeError, IndexError):
            return self.sp.decode(ids)
        return text[1:] if text[:1] == " " else text


class ChunkTable:
    """Ids of the chunks seen so far, in flat arrays, and the pieces' bytes."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        probe = "a  Be\u0301\u00e9 \u00a0\u3000\ufb01 "
        plain = self.sp.normalize(probe) == MARK + probe.replace(" ", MARK)
        self.mark = self.sp.piece_to_id(MARK)
        self.splits = plain and self.mark != self.sp.unk_id() and all(re.fullmatch(f"{MARK}*[^{MARK}]*", p) for p in pieces)
        self.pieces = PieceTable(self.sp)
        self.codes: dict[str, int] = {"": 0}
        self.ids = np.array([self.mark], np.int32)
        self.starts, self.lens = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.used, self.turn = np.zeros(1, np.int64), 0  # when each entry was used last

    def chunks(self, text: str) -> list[str]:
        """Marked words, each without its first marker."""
        text = text.replace(MARK, " ")
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [c[1:] for c in _CHUNK.findall(" " + text)]
        return text.split(" ")

    def learn(self, new: list[str]) -> None:
        found = self.sp.encode(new)
        lens = np.fromiter(map(len, found), np.int64, len(new))
        self.codes.update(zip(new, range(len(self.starts), len(self.starts) + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, np.cumsum(lens) - lens + len(self.ids)])
        self.lens = np.concatenate([self.lens, lens])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(lens.sum()))])
        self.used = np.concatenate([self.used, np.full(len(new), self.turn)])

    def evict(self, most: int) -> None:
        """Keep the entries used last, as many as given, and that of the bare marker."""
        kept = np.sort(np.argsort(-self.used[1:], kind="stable")[: max(most, 0)]) + 1
        kept = np.concatenate([[0], kept])
        place = np.full(len(self.starts), -1, np.int64)
        place[kept] = np.arange(len(kept))
        self.codes = {chunk: int(place[code]) for chunk, code in self.codes.items() if place[code] >= 0}
        lens = self.lens[kept]
        starts = np.cumsum(lens) - lens
        self.ids = self.ids[np.repeat(self.starts[kept] - starts, lens) + np.arange(lens.sum())]
        self.starts, self.lens, self.used = starts, lens, self.used[kept]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Flat ids with the end id, their offsets by text, and the decoded texts."""
        if not self.splits:
            each = self.sp.encode(texts, add_eos=True)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])
            return np.fromiter(chain.from_iterable(each), np.int32, int(offsets[-1])), offsets, self.sp.decode(each)
        words = [self.chunks(t) for t in texts]
        self.turn += 1
        new = [w for w in set().union(*words) if w not in self.codes]
        if new:
            self.learn(new)
        counts = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        self.used[flat] = self.turn
        starts, lens = self.starts[flat], self.lens[flat]
        row_of = np.repeat(np.arange(len(words)), counts)
        sizes = np.bincount(row_of, weights=lens, minlength=len(words)).astype(np.int64) + 1
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        out = np.full(offsets[-1], self.sp.eos_id(), np.int32)
        places = np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        out[np.repeat(row_of, lens) + np.arange(len(places))] = self.ids[places]
        if len(self.codes) > TABLE_ENTRIES:
            self.evict(TABLE_ENTRIES // 2)
        ids = out.tolist()
        return out, offsets, [self.pieces.decode(ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _portions(texts: list[str]) -> Iterator[slice]:
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BATCH_CHARS:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t)
    yield slice(begin, len(texts))


def encode_decode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Add ids (array<int>, end id last) and decoded (string) to each row of docs."""
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    docs = docs.select(*kept)
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in slices(batches):
            table = table or ChunkTable(model_path)
            texts = [t or "" for t in batch.column(kept.index(text)).to_pylist()]
            for part in _portions(texts):
                ids, offsets, decoded = table.encode(texts[part])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(part.start, part.stop - part.start).columns, lists, pa.array(decoded, pa.string())], names=[*kept, "ids", "decoded"])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """Add decoded to rows that hold any ids of the model; null ids decode as none."""

    @F.pandas_udf(T.StringType())
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        table = PieceTable(sentencepiece.SentencePieceProcessor(model_file=model_path))
        for batch in batches:
            yield pd.Series([table.decode([int(i) for i in x]) if x is not None else "" for x in batch], dtype=object)

    return rows.withColumn("decoded", decoded(F.col(ids)))


def id_digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)


def pieces_query(docs: DataFrame, model_path: str) -> DataFrame:
    coded = encode_decode(docs.select("doc_id", "text"), model_path)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), id_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
